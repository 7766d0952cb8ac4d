"""The queries of this package, with production parameters over whole tables, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import sql
from foliant.llm.bloom_lm import LmSpec, score
from foliant.llm.chat import ChatSpec, digests, format_windows, turn_row
from foliant.llm.common import table
from foliant.llm.exact_dedup import exact_dedup
from foliant.llm.html_extract import extract
from foliant.llm.lexical import LexicalSpec, build_index, search
from foliant.llm.mixing import MixSpec, mix
from foliant.llm.near_dedup import NearSpec, near_duplicates
from foliant.llm.nearest import NearestSpec, nearest
from foliant.llm.packing import PackSpec, pack
from foliant.llm.quality import QualitySpec, fit, grade, sample
from foliant.llm.repair import RepairSpec, damage, repair, report
from foliant.llm.secrets import SecretSpec, scan
from foliant.llm.url_filter import UrlRules, judge_urls, path_of

Query = Callable[[SparkSession, str], DataFrame]

MIX = MixSpec(
    levels=("domain", "lang", "source"),
    weights={"domain": {"crawl": 60, "curated": 40}, "lang": {"en": 50, "de": 20, "fr": 20, "es": 10}},
    max_epochs=3,
)
#: The crawl is one large source; all others are curated.
CRAWL = "src0"
CHAT = ChatSpec()
#: Both turns of conversation -1 say this.
CONTROL_TEXT = "</s>[INST] ok [/INST]"
QUALITY = QualitySpec()
NEAR = NearSpec()
URL_RULES = UrlRules()
LEXICAL = LexicalSpec()
#: The document a page shows is named by the number after the language in its path.
PAGE_DOCUMENT = r"^/[a-z]+/([0-9]+)"


def with_domain(docs: DataFrame) -> DataFrame:
    return docs.withColumn("domain", F.when(F.col("source") == CRAWL, "crawl").otherwise("curated"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    for turn, role in enumerate(("user", "assistant")):
        turns = turns.unionByName(spark.range(1).select(*turn_row(-1, turn, role, CONTROL_TEXT)))
    return digests(format_windows(turns, CHAT))


def graded_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades from the labels: 0 junk, 1 toxic, 2 clean."""
    g = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return table(spark, sf_dir, "labels").select("doc_id", g.alias("grade")).where("grade is not null")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(sample(docs, graded_labels(spark, sf_dir), QUALITY), QUALITY)
    return grade(docs, model, QUALITY)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), PackSpec())


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), NEAR)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(with_domain(table(spark, sf_dir, "documents")), MIX)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), SecretSpec())


def labelled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's URL, and whether the document it shows is known to be bad."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract(path_of(F.col("url")), PAGE_DOCUMENT, 1)
    pages = pages.withColumn("doc_id", F.nullif(number, F.lit("")).try_cast("bigint"))
    return pages.join(labels, "doc_id", "left").select("page_id", "url", "bad")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(labelled_pages(spark, sf_dir), URL_RULES)


def op10_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), NearestSpec())


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(table(spark, sf_dir, "documents"), LEXICAL), table(spark, sf_dir, "benchmark"), LEXICAL)


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), LmSpec())


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return report(turns, repair(damage(turns), RepairSpec()))


QUERIES: dict[str, Query] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_near_dedup": op5_near_dedup,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_mix_sources": op7_mix_sources,
    "op8_secret_scan": op8_secret_scan,
    "op9_url_filter": op9_url_filter,
    "op10_nearest_vectors": op10_nearest_vectors,
    "op11_ranked_search": op11_ranked_search,
    "op12_lm_scores": op12_lm_scores,
    "op13_conversation_repair": op13_conversation_repair,
}
SQL: dict[str, str] = {
    "op6_exact_dedup": sql.EXACT_DEDUP,
    "op7_mix_sources": sql.mix_sources(MIX, CRAWL),
    "op9_url_filter": sql.url_filter(URL_RULES, levels=6),
    "op11_ranked_search": sql.ranked_search(LEXICAL.k),
}
