"""Queries of classification, text features and trained models."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant import config
from foliant.operators import classify as C
from foliant.operators import ml, stats
from foliant.operators.tables import layout_from_blocks
from foliant.plans import sql as Q
from foliant.plans.queries_extract import BLOCKS
from foliant.plans.registry import query
from foliant.session import materialize, work_path, written
from foliant.sources import adapters as A


def texts(spark, d):
    return A.order_text(A.order_docs(spark, d)).select("document_id", "key", "full_text")


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _share(text, words):
    return "(" + "+".join(f"contains({text},'{w}')::int" for w in words) + f")/{len(words)}.0::double"


def keyword_sql(text):
    """Columns kc, ks: best class and its score."""
    arms, scores = [], {n: _share(text, w) for n, w in config.KEYWORD_CLASSES.items()}
    best = "greatest(" + ",".join(scores.values()) + ")"
    for n, s in scores.items():
        arms.append(f"when {s}={best} then '{n}'")
    return f"case when {best}=0 then 'unknown' {' '.join(arms)} end as kc, case when {best}=0 then 0.4 else least({best}*0.6,0.8) end::double as ks"


KW = f"{Q.TX}, lw as (select *, lower(full_text) as lt from tx), kw as (select document_id, key, {keyword_sql('lt')} from lw)"


@query("classify_keywords", f"with {KW} select document_id, kc as keyword_class, round(ks,6) as keyword_confidence from kw")
def _(spark, d):
    return r6(C.classify_keywords(texts(spark, d), "full_text").select("document_id", "keyword_class", "keyword_confidence"), "keyword_confidence")


MODELS = [("prebuilt-invoice", "invoice"), ("prebuilt-receipt", "receipt"), ("prebuilt-idDocument", "id_document")]
EXPECTED = {"invoice": ["invoice_number", "total_amount", "vendor_name"], "receipt": ["total_amount", "invoice_date"], "id_document": ["due_date", "first_name"]}


def detected(spark, d):
    """Every model sees every extracted field, with a confidence shifted per model."""
    ef = A.extracted_fields(spark, d).groupBy("document_id", "field_name").agg(F.max("confidence").alias("c"))
    models = F.array(*[F.struct(F.lit(i).alias("model_pos"), F.lit(m).alias("model_id"), F.lit(t).alias("document_type")) for i, (m, t) in enumerate(MODELS)])
    return ef.select("document_id", "field_name", "c", F.explode(models).alias("m")).select(
        "document_id", "field_name", "m.*", F.when(F.col("m.model_pos") == 2, F.lit(0.0)).otherwise(F.col("c") - F.col("m.model_pos") * 0.1).alias("confidence"))


_DET = f"""{Q.EF}, e0 as (select document_id, field_name, max(confidence) as c from ef group by 1,2),
  mo(model_pos, model_id, document_type) as (values {','.join(f"({i},'{m}','{t}')" for i, (m, t) in enumerate(MODELS))}),
  ex(document_type, field_name, n) as (values {','.join(f"('{t}','{f}',{len(fs)})" for t, fs in EXPECTED.items() for f in fs)}),
  det as (select document_id, field_name, model_pos, model_id, document_type, case when model_pos=2 then 0.0 else c-model_pos*0.1 end::double as c from e0, mo),
  sc as (select document_id, model_id, document_type, any_value(model_pos) as model_pos, coalesce(least(1.0, count(*)*0.4/any_value(n) + avg(case when c<>0 then c end)*0.6),0.0)::double as score from det join ex using (document_type, field_name) group by 1,2,3)"""


@query("score_prebuilt_models", f"with {_DET} select document_id, model_id, round(score,6) as score from sc")
def _(spark, d):
    out = C.score_prebuilt_models(detected(spark, d), C.expected_fields(spark, EXPECTED), ["document_id"])
    return r6(out.select("document_id", "model_id", "score"), "score")


def scored(spark, d):
    s = C.score_prebuilt_models(detected(spark, d), C.expected_fields(spark, EXPECTED), ["document_id"])
    pos = F.create_map(*[F.lit(x) for i, (m, _) in enumerate(MODELS) for x in (m, i)])
    return s.withColumns({"model_pos": pos[F.col("model_id")], "score": F.round("score", 9)})


_BEST = f"{_DET}, s9 as (select *, round(score,9) as s from sc where round(score,9)>=0.7), bm as (select document_id, arg_max(document_type, s*1000-model_pos*0.000001) as document_type, max(s) as confidence from s9 group by 1)"


@query("best_model", f"with {_BEST} select document_id, document_type, round(confidence,6) as confidence from bm")
def _(spark, d):
    return r6(C.best_model(scored(spark, d), ["document_id"]).select("document_id", "document_type", "confidence"), "confidence")


@query("classify_cascade", f"""with {_BEST}, {KW} select kw.document_id, case when bm.document_id is not null then bm.document_type when key%9=0 then 'unknown' else kc end as document_type,
  round(case when bm.document_id is not null then bm.confidence when key%9=0 then 0.3 else ks end,6) as confidence from kw left join bm using (document_id)""")
def _(spark, d):
    kw = C.classify_keywords(texts(spark, d), "full_text").select("document_id", "key", "keyword_class", "keyword_confidence")
    best = C.best_model(scored(spark, d), ["document_id"]).select("document_id", F.struct("document_type", "confidence").alias("model"))
    out = C.classify_cascade(kw.join(best, "document_id", "left"), model=F.col("model"), has_image=F.col("key") % 9 != 0,
                             keywords=F.struct(F.col("keyword_class").alias("document_type"), F.col("keyword_confidence").alias("confidence")))
    return r6(out.select("document_id", "classification.document_type", "classification.confidence"), "confidence")


def pages(spark, d):
    """Conversation turns as pages; each carries keywords by turn and role in front of its text."""
    head = A.pick(["invoice amount due ", "receipt total ", "agreement ", "invoice ", "balance of account "], F.col("conv_id") + F.col("turn"))
    t = A.table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.concat(head, "text").alias("t"))
    out = C.classify_keywords(t, "t")
    return out.select("doc", "page", F.col("keyword_class").alias("document_type"), F.col("keyword_confidence").alias("confidence"))


PG = f"""c0 as (select conv_id as doc, turn as page, lower({Q.pick(['invoice amount due ', 'receipt total ', 'agreement ', 'invoice ', 'balance of account '], '(conv_id+turn)')}||text) as lt from conversations),
  pg as (select doc, page, {keyword_sql('lt')} from c0)"""


@query("vote_pages", f"with {PG}, v as (select doc, kc, round(sum(ks),9) as w, min(page) as f from pg group by 1,2) select doc, kc as document_type from v qualify row_number() over (partition by doc order by w desc, f)=1")
def _(spark, d):
    return C.vote_pages(pages(spark, d), "doc")


@query("page_confidence", f"with {PG} select doc, round(avg(ks),6) as confidence from pg group by 1")
def _(spark, d):
    return r6(C.page_confidence(pages(spark, d), "doc"), "confidence")


@query("aggregate_probabilities", f"""with {PG}, n as (select doc, count(distinct page) as n from pg group by 1), p as (select doc, kc as t, ks as p from pg union all select doc, 'other', 1-ks from pg)
  select doc, t as document_type, round(sum(p)/any_value(n),6) as probability from p join n using (doc) group by 1,2""")
def _(spark, d):
    p = pages(spark, d).withColumn("probabilities", F.create_map("document_type", "confidence", F.lit("other"), 1 - F.col("confidence")))
    return r6(C.aggregate_probabilities(p, "doc"), "probability")


_WS = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_WORDS = f"string_split_regex(regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g'), '{_WS}+')"
_LETTERS = "length(regexp_replace(text,'\\P{L}+','','g'))"
_LATIN = "length(regexp_replace(lower(text),'[^a-z]+','','g'))"
_LANG = f"case when {_LETTERS}=0 then 'unknown' when {_LATIN}/{_LETTERS} > 0.8 then 'english' else 'other' end"
_TF = f"""w as (select doc_id, text, {_WORDS} as words from documents),
  tf as (select doc_id, len(words)::integer as word_count, len(list_distinct(words))::integer as unique_word_count, round(length(regexp_replace(text,'{_WS}+','','g'))/len(words),6) as avg_word_length,
   len(list_filter(string_split(text,'.'), lambda s: regexp_matches(s,'[^ \\s\\x{{0b}}]')))::integer as sentence_count, {_LANG} as language, regexp_matches(text,'[0-9]') as has_numbers,
   regexp_matches(text,'\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{4}}') as has_dates, regexp_matches(text,'[$€£¥]|\\b\\d+\\.\\d{{2}}\\b') as has_currency,
   regexp_matches(text,'\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{{2,}}\\b') as has_email, regexp_matches(text,'\\b\\d{{3}}[-.]?\\d{{3}}[-.]?\\d{{4}}\\b') as has_phone from w)"""


def features(spark, d):
    return C.text_features(A.documents(spark, d).select("doc_id", "lang", "text"), "text")


@query("text_features", f"with {_TF} select *, round(word_count/greatest(sentence_count,1),6) as avg_sentence_length from tf")
def _(spark, d):
    return r6(features(spark, d), "avg_word_length", "avg_sentence_length").drop("lang", "text")


@query("detect_language", f"with {_TF} select language, count(*) as documents from tf group by 1")
def _(spark, d):
    from foliant.functions.text import detect_language

    return A.documents(spark, d).groupBy(detect_language(F.col("text")).alias("language")).agg(F.count(F.lit(1)).alias("documents"))


_STOP = ",".join(f"'{w}'" for w in config.STOP_WORDS)


@query("key_phrases", f"""with w as (select doc_id, {_WORDS.replace('text', 'lower(text)')} as words from documents), x as (select doc_id, unnest(words) as w, generate_subscripts(words,1) as p from w),
  c as (select doc_id, w, count(*) as n, min(p) as f from x group by 1,2), t as (select *, row_number() over (partition by doc_id order by n desc, f) as r from c qualify r<=10),
  k as (select *, row_number() over (partition by doc_id order by r) as q from t where w not in ({_STOP}) and length(w)>3 qualify q<=5)
  select documents.doc_id, coalesce(string_agg(w, ' ' order by q),'') as key_phrases from documents left join k using (doc_id) group by 1""")
def _(spark, d):
    docs = A.documents(spark, d).select("doc_id", "text")
    return C.key_phrases(docs, "text").select("doc_id", F.array_join("key_phrases", " ").alias("key_phrases"))


_TEXT_VALUES = ("word_count", "unique_word_count", "avg_word_length", "sentence_count", "word_count/greatest(sentence_count,1)", "(language='english')::int", "has_numbers::int",
                "has_dates::int", "has_currency::int", "has_email::int", "has_phone::int")


@query("feature_vector", f"with {_TF} select doc_id, " + ", ".join(f"0.0::double as f{i}" for i in range(len(C.LAYOUT_FEATURES))) + ", " + ", ".join(
    f"round({x}::double,6) as f{len(C.LAYOUT_FEATURES) + i}" for i, x in enumerate(_TEXT_VALUES)) + " from tf")
def _(spark, d):
    """All values of the vector, in its order; documents without a layout have zeros for it."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows, names = ml.feature_frame(features(spark, d), ["doc_id"], with_layout=True)
    v = VectorAssembler(inputCols=names, outputCol="v").transform(rows).select("doc_id", vector_to_array("v").alias("a"))
    return v.select("doc_id", *[F.round(F.col("a")[i], 6).alias(f"f{i}") for i in range(len(names))])


_ORDER_TF = _TF.replace("from documents)", "from (select document_id as doc_id, full_text as text from tx))")
_LAYOUT_VALUES = ("612.0", "792.0", "612.0/792.0", "area/(612.0*792.0)", "1-area/(612.0*792.0)", "n", "area/n", "0.0", "sm/n", "md/n", "lg/n", "mt/792.0", "(792.0-mb)/792.0", "ml/612.0",
                  "(612.0-mr)/612.0")


@query("feature_vector_layout", f"""with {BLOCKS}, {_ORDER_TF},
  a as (select document_id, count(*) n, sum(bl.w*h) area, min(x) ml, max(x+bl.w) mr, min(y) mt, max(y+h) mb, quantile_cont(h,0.33) p33, quantile_cont(h,0.67) p67 from bl group by 1),
  s as (select document_id, count(*) filter (h<=p33) sm, count(*) filter (h>p33 and h<=p67) md, count(*) filter (h>p67) lg from bl join a using (document_id) group by 1)
  select a.document_id, """ + ", ".join(f"round(({x})::double,6) as {n}" for n, x in zip((*C.LAYOUT_FEATURES, *C.TEXT_FEATURES), (*_LAYOUT_VALUES, *_TEXT_VALUES))) +
       " from a join s using (document_id) join tf on tf.doc_id=a.document_id")
def _(spark, d):
    docs = layout_from_blocks(A.ocr_docs(spark, d).select("document_id", "full_text", "text_blocks"))
    rows, names = ml.feature_frame(C.text_features(docs, "full_text"), ["document_id"], with_layout=True)
    return r6(rows.select("document_id", *names), *names)


def trained(spark, d, kind="random_forest", **options):
    """A model of the documents' languages, and the rows that it was fitted on."""
    rows, names = ml.feature_frame(features(spark, d), ["doc_id", "lang"])
    rows = materialize(rows)
    return ml.train_classifier(rows, names, "lang", kind, **options), rows


#: One document in so many is held out of a fit, and the least share of a type's held-out documents that must be told.
HELD_OUT, LEAST_RECALL = 4, 0.95


def told(spark, d, kind, fits=1, **options):
    """Per type: its held-out documents, whether enough of them were told by a model that never saw them, and whether all fits say the same."""
    typed = A.order_text(A.order_docs(spark, d)).select("key", F.col("document_type").alias("label"), "full_text")
    rows, names = ml.feature_frame(C.text_features(typed, "full_text"), ["key", "label"])
    rows = written(rows, "features")
    seen = rows.where(F.col("key") % HELD_OUT != 0)
    # A model says the same of documents with the same features, and each is asked about them once.
    said = ml.counted(rows.where(F.col("key") % HELD_OUT == 0), [*names, "label"], "n")
    for i in range(fits):
        said = ml.predict_class(ml.train_classifier(seen, names, "label", kind, **options), said).withColumnRenamed("document_type", f"said{i}").drop("confidence", "probabilities")
    each = F.array(*[F.col(f"said{i}") for i in range(fits)])
    right = F.sum(F.when(F.col("label") == F.array_min(each), F.col("n")).otherwise(0))
    return said.groupBy("label").agg(F.sum("n").alias("documents"), (right / F.sum("n") >= LEAST_RECALL).alias("told"),
                                     F.bool_and(F.array_min(each) == F.array_max(each)).alias("same_again"))


_TOLD = f"with {Q.OD} select document_type as label, count(*) as documents, true as told, true as same_again from od where key%{HELD_OUT}=0 group by 1"


@query("train_classifier", _TOLD)
def _(spark, d):
    return told(spark, d, "random_forest")


@query("train_svm", _TOLD)
def _(spark, d):
    return told(spark, d, "svm", fits=2)


@query("train_gradient_boost", _TOLD)
def _(spark, d):
    """One boosted model of ten trees against the rest, for each type."""
    return told(spark, d, "gradient_boost", trees=10)


@query("predict_class", "select doc_id, (select count(distinct lang) from documents)::integer as classes, true as whole, true as best from documents")
def _(spark, d):
    model, rows = trained(spark, d, "logistic")
    p = F.map_values("probabilities")
    out = ml.predict_class(model, rows).withColumn("p", p)
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    return out.select("doc_id", F.size("p").alias("classes"), (F.abs(total - 1) < 1e-9).alias("whole"), (F.col("confidence") == F.array_max("p")).alias("best"))


@query("save_load_model", "select doc_id, true as agrees from documents")
def _(spark, d):
    model, rows = trained(spark, d)
    path = work_path(spark, "model")
    ml.save_model(model, path)
    # Both models over one reading of the rows.
    both = ml.predict_class(model, rows).withColumnRenamed("document_type", "before").drop("confidence", "probabilities")
    return ml.predict_class(ml.load_model(path), both).select("doc_id", (F.col("before") == F.col("document_type")).alias("agrees"))


@query("retrain_gate", "with c as (select label, count(*) n from embeddings group by 1) select count(*) as classes, min(n) as smallest_class, count(*)>=2 and min(n)>=10 as should_retrain from c")
def _(spark, d):
    return stats.retrain_gate(A.table(spark, d, "embeddings"))


@query("class_distribution", f"with {KW} select kc as document_type, count(*) as count from kw group by 1")
def _(spark, d):
    return stats.class_distribution(C.classify_keywords(texts(spark, d), "full_text").withColumnRenamed("keyword_class", "document_type"))


@query("classification_stats", f"with {KW} select kc as document_type, count(*) as total_classified, round(avg(ks),6) as avg_confidence, round(avg((key%90)/10.0),6) as avg_processing_time, min((key%90)/10.0)::double as min_processing_time, max((key%90)/10.0)::double as max_processing_time from kw group by 1")
def _(spark, d):
    k = C.classify_keywords(texts(spark, d), "full_text").select(
        F.col("keyword_class").alias("document_type"), F.col("keyword_confidence").alias("confidence"), (F.col("key") % 90 / 10.0).alias("processing_time"))
    return r6(stats.classification_stats(k, ["document_type"]), "avg_confidence", "avg_processing_time")


_MODEL_ID = "case when p_partkey%3=0 then 'prebuilt-'||p_type||'.v'||(p_partkey%10) else p_brand||'-'||p_type end"
_DT = "lower(replace(replace(case when starts_with(m,'prebuilt-') then substr(m,10) else m end,'.','_'),'-','_'))"
_INF = "case " + " ".join("when " + " or ".join(f"contains(t,'{w}')" for w in ws) + f" then '{','.join(n)}'" for ws, n in config.INFERRED_FIELDS) + f" else '{','.join(config.INFERRED_DEFAULT)}' end"


@query("doc_type_from_model", f"with m as (select p_partkey, {_MODEL_ID} as m from part), t as (select p_partkey, {_DT} as t from m) select p_partkey, t as document_type, {_INF} as fields from t")
def _(spark, d):
    p = F.col("p_partkey")
    m = F.when(p % 3 == 0, F.concat(F.lit("prebuilt-"), "p_type", F.lit(".v"), (p % 10).cast("string"))).otherwise(F.concat_ws("-", "p_brand", "p_type"))
    out = A.table(spark, d, "part").select("p_partkey", C.doc_type_from_model(m).alias("document_type"))
    return out.select("p_partkey", "document_type", F.array_join(C.inferred_fields(F.col("document_type")), ",").alias("fields"))


def _case(table, default):
    return "case lower(kc) " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + f" else '{default}' end"


@query("select_ocr_model", f"with {KW} select document_id, {_case(config.MODEL_BY_CLASS, config.DEFAULT_MODEL)} as model from kw")
def _(spark, d):
    k = C.classify_keywords(texts(spark, d), "full_text")
    return k.select("document_id", C.select_ocr_model(F.col("keyword_class")).alias("model"))


@query("map_template", f"with {KW} select document_id, {_case(config.TEMPLATE_BY_CLASS, 'custom')} as template from kw")
def _(spark, d):
    k = C.classify_keywords(texts(spark, d), "full_text")
    return k.select("document_id", C.map_template(F.col("keyword_class")).alias("template"))
