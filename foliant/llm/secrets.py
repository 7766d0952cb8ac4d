"""Secret scans with corpus-wide ownership.

Patterns find candidates in each whole text: assigned passwords and tokens, access keys, long hex strings, and besides these strings
of known credential formats and long mixed strings of high entropy. Every candidate's value is hashed, and the corpus is asked
for each hash in how many repositories (documents) and of how many owners (sources) it is. A value that many owners have,
or that an owner has in many repositories, is a copied example; one that hardly anybody else has, and that looks as if it were in use, is a
live credential.

The three base kinds are always reported as they are found. Candidates of the other kinds become spans of kind ``live`` where
ownership says so, and every base span is told to be live, an example or neither in the counts.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import keep


@dataclass(frozen=True)
class SecretSpec:
    #: A value of more owners than this is a copied example.
    max_owners: int = 2
    #: So is one of more repositories than this for each of its owners.
    max_repositories_per_owner: int = 10
    #: Least entropy of a value that looks live, in bits per character.
    min_entropy: float = 3.0
    #: Least length of a long mixed string.
    min_mixed: int = 20


# The base patterns. Each of the last two finds what the shorter pattern in the contract finds and drops short matches at once.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
MIN_ASSIGNED = 8
BASE = ("assign", "access", "hex")
# Public credential formats.
FORMATS = re.compile(
    r"gh[pousr]_[A-Za-z0-9]{36,}|xox[baprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|[sr]k_live_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+|"
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*")
MIXED = re.compile(r"[A-Za-z0-9+/_-]{16,}")
#: What a placeholder says.
PLACEHOLDER = re.compile(r"example|sample|changeme|placeholder|your[_-]|xxxx|1234567|abcdef", re.IGNORECASE)


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value), sorted."""
    out = [(m.start(), 0, m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= MIN_ASSIGNED]
    out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def more_spans(text: str, taken: list[tuple[int, int, int, str]], spec: SecretSpec) -> list[tuple[int, int, str]]:
    """(start, end, value) of known formats and of long mixed strings outside what is taken."""
    used = [(s, e) for s, _, e, _ in taken]
    out = []
    for pattern, mixed in ((FORMATS, False), (MIXED, True)):
        for m in pattern.finditer(text):
            v = m[0]
            if mixed and (len(v) < spec.min_mixed or not any(map(str.isdigit, v)) or not any(map(str.isupper, v)) or not any(map(str.islower, v))):
                continue
            if not any(s < m.end() and m.start() < e for s, e in used):
                used.append((m.start(), m.end()))
                out.append((m.start(), m.end(), v))
    return sorted(out)


def candidates(docs: DataFrame, spec: SecretSpec, id_col: str, text_col: str, owner_col: str) -> DataFrame:
    """``doc_id, owner, n_assign, n_access, n_hex, base_sha256, found``: ``found`` has the base spans and then the others, each with a hash of its value and whether it looks live."""
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("h", pa.string()), ("live", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sums, lists = [], [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                found = [(BASE[k], s, e, v) for s, k, e, v in base]
                counts.append([sum(k == i for _, k, _, _ in base) for i in range(3)])
                sums.append(hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e, _ in found).encode()).hexdigest())
                found += [("live", s, e, v) for s, e, v in more_spans(text or "", base, spec)]
                lists.append([{"kind": k, "start": s, "end": e, "h": hashlib.sha256(v.encode()).hexdigest(), "live": entropy(v) >= spec.min_entropy and not PLACEHOLDER.search(v)}
                              for k, s, e, v in found])
            cols = [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("owner"), *cols, pa.array(sums, pa.string()), pa.array(lists, pa.list_(item))],
                                             names=["doc_id", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "found"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, owner string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, "
                                "found array<struct<kind string, start bigint, end bigint, h string, live boolean>>")


def ownership(found: DataFrame) -> DataFrame:
    """``h, repositories, owners``: in how many documents and of how many owners each value is; from ``h, owner, doc_id``."""
    per_owner = found.distinct().groupBy("h", "owner").agg(F.count(F.lit(1)).alias("n"))
    return per_owner.groupBy("h").agg(F.sum("n").alias("repositories"), F.count(F.lit(1)).alias("owners"))


def scan(docs: DataFrame, spec: SecretSpec = SecretSpec(), id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """One row per input row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, repositories, owners``.

    ``spans`` are kind:start:end in code points (end exclusive), by start and then kind: the base kinds and ``live``. ``n_live`` counts
    all spans whose value looks live and is no copied example, ``n_example`` those of copied examples: values of more than ``max_owners`` owners or of more
    than ``max_repositories_per_owner`` repositories for each owner. ``repositories`` and ``owners`` are the two counts of each span's value, in the order of ``spans``. A null or
    empty text has none; a null owner is the empty one. Rows that are there twice are scanned twice and count as one repository; null ids count as one
    too. Other columns of the input are not looked at; an empty table gives an empty result.
    """
    rows = keep(candidates(docs, spec, id_col, text_col, owner_col).withColumn("row", F.monotonically_increasing_id()), "candidates")
    each = rows.where(F.size("found") > 0).select("row", "doc_id", "owner", F.explode("found").alias("c")).select("row", "doc_id", "owner", "c.*")
    owned = keep(ownership(each.select("h", "owner", "doc_id")), "ownership")
    example = (F.col("owners") > spec.max_owners) | (F.col("repositories") > F.col("owners") * spec.max_repositories_per_owner)
    judged = each.join(owned, "h").withColumn("is_example", example).withColumn("is_live", F.col("live") & ~F.col("is_example"))
    judged = judged.where((F.col("kind") != "live") | F.col("is_live"))
    order = F.when(F.col("kind") == "assign", 0).when(F.col("kind") == "access", 1).when(F.col("kind") == "hex", 2).otherwise(3)
    span = F.struct("start", order.alias("o"), F.concat_ws(":", "kind", "start", "end").alias("s"), "repositories", "owners")
    per_row = judged.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("found"),
                                        F.count_if("is_live").alias("n_live"), F.count_if("is_example").alias("n_example"))
    per_row = per_row.select("row", F.array_join("found.s", ",").alias("spans"), "n_live", "n_example", F.col("found.repositories").alias("repositories"), F.col("found.owners").alias("owners"))
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")
    return rows.join(per_row, "row", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("spans", F.lit("")).alias("spans"),
                                                    F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_example", zero).alias("n_example"),
                                                    F.coalesce("repositories", none).alias("repositories"), F.coalesce("owners", none).alias("owners"))
