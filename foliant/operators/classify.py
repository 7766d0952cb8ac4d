"""Document classes: keywords, page votes, recognition-model scores, and text features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant import config
from foliant.sources.literals import literal_frame
from foliant.functions import text as T

LAYOUT_FEATURES = ["page_width", "page_height", "aspect_ratio", "text_density", "white_space_ratio", "text_block_count", "average_text_block_size",
                   "has_logo", "font_small", "font_medium", "font_large", "margin_top", "margin_bottom", "margin_left", "margin_right"]
TEXT_FEATURES = ["word_count", "unique_word_count", "avg_word_length", "sentence_count", "avg_sentence_length", "is_english",
                 "has_numbers", "has_dates", "has_currency", "has_email", "has_phone"]


def classify_keywords(df: DataFrame, text_col: str, classes: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds ``keyword_class`` and ``keyword_confidence``: the class with the largest share of its keywords in the text."""
    classes = config.KEYWORD_CLASSES if classes is None else classes
    low = F.col("__low")
    scores = []
    for i, (name, keywords) in enumerate(classes.items()):
        hits = F.lit(0)
        for k in keywords:
            hits = hits + low.contains(k).cast("int")
        scores.append(F.struct((hits / len(keywords)).alias("score"), F.lit(-i).alias("ord"), F.lit(name).alias("name")))
    best = F.col("__best")
    hit = best["score"] > 0
    return (
        df.withColumn("__low", F.lower(text_col)).withColumn("__best", F.array_max(F.array(*scores)))
        .withColumn("keyword_class", F.when(hit, best["name"]).otherwise("unknown"))
        .withColumn("keyword_confidence", F.when(hit, F.least(best["score"] * 0.6, F.lit(0.8))).otherwise(F.lit(0.4)))
        .drop("__low", "__best")
    )


def expected_fields(spark, expected: dict[str, list[str]]) -> DataFrame:
    rows = [(t, n, len(names)) for t, names in expected.items() for n in names]
    return literal_frame(spark, rows, "document_type string, field_name string, expected int")


def score_prebuilt_models(detected: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Score per document and model from (keys, model_id, document_type, field_name, confidence) and the expected fields."""
    c = F.col("confidence")
    hit = detected.join(expected, ["document_type", "field_name"])
    score = F.least(F.count(F.lit(1)) / F.first("expected") * 0.4 + F.avg(F.when(c != 0, c)) * 0.6, F.lit(1.0))
    return hit.groupBy(*keys, "model_id", "document_type").agg(F.coalesce(score, F.lit(0.0)).alias("score"))


def best_model(scores: DataFrame, keys: list[str], order: str = "model_pos", threshold: float = config.MODEL_THRESHOLD) -> DataFrame:
    """The best model at or above the threshold; the first tried wins ties."""
    s = F.struct("score", (-F.col(order)).alias("o"))
    return scores.where(F.col("score") >= threshold).groupBy(*keys).agg(
        F.max_by("model_id", s).alias("model_id"), F.max_by("document_type", s).alias("document_type"), F.max("score").alias("confidence"))


def classify_cascade(df: DataFrame, *, model: Column | None = None, trained: Column | None = None, keywords: Column | None = None,
                     has_image: Column | None = None, failed: Column | None = None) -> DataFrame:
    """Adds ``classification``: model result, else trained classifier, else keywords, else unknown.

    Each input is a (document_type, confidence) struct, NULL where it has no answer. Unknown carries
    0.3 without a page image, 0.2 after a failure and 0.1 without any classifier.
    """
    def unknown(c):
        return F.struct(F.lit("unknown").alias("document_type"), F.lit(c).alias("confidence"))

    steps = [model]
    if trained is None and keywords is None:
        steps.append(unknown(0.1))
    else:
        if failed is not None:
            steps.append(F.when(failed, unknown(0.2)))
        if has_image is not None:
            steps.append(F.when(~has_image, unknown(0.3)))
        steps += [trained, keywords, unknown(0.2)]
    return df.withColumn("classification", F.coalesce(*[s for s in steps if s is not None]))


def vote_pages(pages: DataFrame, key: str, order: str = "page") -> DataFrame:
    """Class of a document: confidence summed per class over its pages, largest sum, earliest page on ties."""
    votes = pages.groupBy(key, "document_type").agg(F.sum("confidence").alias("weight"), F.min(order).alias("first"))
    return votes.groupBy(key).agg(F.max_by("document_type", F.struct(F.round("weight", 9), -F.col("first"))).alias("document_type"))


def page_confidence(pages: DataFrame, key: str) -> DataFrame:
    return pages.groupBy(key).agg(F.avg("confidence").alias("confidence"))


def aggregate_probabilities(pages: DataFrame, key: str, page: str = "page") -> DataFrame:
    """Mean probability per class over all pages of a document; a class a page lacks counts as zero."""
    n = pages.groupBy(key).agg(F.countDistinct(page).alias("__n"))
    sums = pages.select(key, F.explode_outer("probabilities").alias("document_type", "p")).where(F.col("document_type").isNotNull()).groupBy(key, "document_type").agg(F.sum("p").alias("__p"))
    return sums.join(n, key).select(key, "document_type", (F.col("__p") / F.col("__n")).alias("probability"))


def text_features(df: DataFrame, text_col: str) -> DataFrame:
    """Adds the text features as columns, and ``language``."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    words = F.col("__words")
    n = F.size(words)
    # One match for each part between dots that is not blank: from its first visible character to the next dot.
    sentences = F.regexp_count(t, F.lit(f"[^.{T.WS_CHARS}][^.]*"))
    step = df.withColumn("__words", T.words(t)).withColumns({
        "word_count": n, "unique_word_count": F.size(F.array_distinct(words)),
        "avg_word_length": F.length(F.regexp_replace(t, f"{T.WS}+", "")) / F.greatest(n, F.lit(1)), "sentence_count": sentences,
        "language": T.detect_language(t), "has_numbers": T.has_numbers(t), "has_dates": T.has_dates(t), "has_currency": T.has_currency(t),
        "has_email": T.has_email(t), "has_phone": T.has_phone(t)})
    return step.withColumn("avg_sentence_length", F.col("word_count") / F.greatest(F.col("sentence_count"), F.lit(1))).drop("__words")


def key_phrases(df: DataFrame, text_col: str) -> DataFrame:
    """Adds ``key_phrases``: five of the ten most frequent words, stop words and short ones dropped."""
    step = df.withColumn("__words", T.words(F.lower(text_col)))
    pairs, runs, phrases = T.key_phrases(F.col("__words"))
    out = step.withColumn("sorted", pairs).withColumn("starts", runs).withColumn("key_phrases", phrases)
    return out.drop("__words", "sorted", "starts")


def feature_columns(df: DataFrame, with_layout: bool = True) -> list[Column]:
    """The feature columns as doubles in vector order; missing layout features count as zero."""
    names = [*(LAYOUT_FEATURES if with_layout else []), *TEXT_FEATURES]
    src = {"is_english": (F.col("language") == "english")} if "language" in df.columns else {}
    return [F.coalesce(src.get(n, F.col(n) if n in df.columns else F.lit(0.0)).cast("double"), F.lit(0.0)).alias(n) for n in names]


def doc_type_from_model(model_id: Column) -> Column:
    base = F.when(model_id.startswith("prebuilt-"), F.substr(model_id, F.lit(10))).otherwise(model_id)
    return F.lower(F.regexp_replace(base, "[.-]", "_"))


def inferred_fields(document_type: Column) -> Column:
    low = F.lower(document_type)
    arr = lambda names: F.array(*[F.lit(n) for n in names])
    out = None
    for words, names in config.INFERRED_FIELDS:
        cond = low.contains(words[0])
        for w in words[1:]:
            cond = cond | low.contains(w)
        out = F.when(cond, arr(names)) if out is None else out.when(cond, arr(names))
    return out.otherwise(arr(config.INFERRED_DEFAULT))


def _lookup(table: dict[str, str], key: Column, default: str) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, F.lower(key)), F.lit(default))


def select_ocr_model(document_class: Column, custom: dict[str, str] | None = None) -> Column:
    base = _lookup(config.MODEL_BY_CLASS, document_class, config.DEFAULT_MODEL)
    return F.when(document_class.isin(*custom), "custom").otherwise(base) if custom else base


def map_template(document_class: Column) -> Column:
    return _lookup(config.TEMPLATE_BY_CLASS, document_class, "custom")
