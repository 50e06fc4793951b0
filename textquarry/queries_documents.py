"""Queries of the document operators: metrics, filters, cleaning, tokens, duplicates, validation, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textquarry.functions import metrics as M
from textquarry.functions import text as T
from textquarry.functions.cleaning import EMAIL, URL, TextCleaner, collapse_blanks, remove_control, remove_emails, remove_urls
from textquarry.functions.language import FUNCTION_WORDS, detect_language
from textquarry.operators import dedup as D
from textquarry.operators import filters as FL
from textquarry.operators import splits as S
from textquarry.operators import tokenization as K
from textquarry.operators import validation as V
from textquarry.registry import SQL, query
from textquarry.runtime import spread, table

_W = T.WORD
_B = T.BLANK.replace("\\t", "\t").replace("\\n", "\n").replace("\\f", "\f").replace("\\r", "\r")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


_BASE = rf"""
b as (select doc_id, text as t, regexp_extract_all(text, '{_W}') as w, regexp_extract_all(lower(text), '{_W}') as lw,
        list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_replace(x, '^{_B}+|{_B}+$', '', 'g')), lambda x: x <> '') as s,
        len(regexp_split_to_array(text, '[.!?]+')) as pieces, regexp_replace(text, '{_B}', '', 'g') as solid from documents where text is not null),
c as (select *, list_transform(lw, lambda x: greatest(1, len(regexp_extract_all(x, '[aeiouy]+')) - case when x like '%e' and len(regexp_extract_all(x, '[aeiouy]+')) > 1 then 1 else 0 end)) as sy from b),
m as (select *, len(w) as nw, len(s) as ns, coalesce(list_sum(sy), 0) as nsy, len(list_filter(sy, lambda x: x >= 3)) as np,
        len(list_filter(w, lambda x: length(x) > 2 and not regexp_matches(x, '^\p{{Lu}}') and not regexp_matches(x, '(?:es|ed|ing)$')
            and greatest(1, len(regexp_extract_all(lower(x), '[aeiouy]+')) - case when lower(x) like '%e' and len(regexp_extract_all(lower(x), '[aeiouy]+')) > 1 then 1 else 0 end) >= 3)) as nc from c)"""

_FRE = "case when nw > 0 and ns > 0 then greatest(0.0, least(100.0, 206.835::double - 1.015::double * (nw::double / ns) - 84.6::double * (nsy::double / nw))) else 0.0::double end"
_FK = "case when nw > 0 and ns > 0 then greatest(0.0::double, 0.39::double * (nw::double / ns) + 11.8::double * (nsy::double / nw) - 15.59::double) else 0.0::double end"
_VR = "case when nw > 0 then len(list_distinct(lw))::double / nw else 0.0::double end"


def _gram(n: int) -> str:
    parts = " || ' ' || ".join(f"lw[i + {k}]" for k in range(n))
    return f"case when nw >= {n} then len(list_distinct(list_transform(range(1, nw - {n} + 2), lambda i: {parts})))::double / (nw - {n} + 1) else 0.0::double end"


_ENTROPY = "coalesce((select greatest(0.0::double, log2(sum(k)::double) - sum(k * log2(k::double)) / sum(k)) from (select count(*) as k from (select unnest(lw) as x) group by x)), 0.0::double)"
_REP = f"case when len(list_distinct(lw)) > 1 then greatest(0.0::double, least(1.0::double, 1 - {_ENTROPY} / log2(len(list_distinct(lw))::double))) else 1.0::double end"
_SPELL = r"case when nw > 0 then len(list_filter(w, lambda x: length(x) < 2 or length(x) > 20 or regexp_matches(lower(x), '[bcdfghjklmnpqrstvwxz]{4,}') or regexp_matches(lower(x), '[aeiou]{4,}') or regexp_matches(lower(x), '[0-9].*[a-z].*[0-9]')))::double / nw else 0.0::double end"
_PUNCT = rf"case when ns > 0 then list_sum(list_transform(s, lambda x: case when regexp_matches(x, '^\p{{Lu}}') then 1 else 0 end + case when length(regexp_replace(x, '[\p{{L}}\p{{N}}_]|{_B}', '', 'g')) < 0.1 * length(x) then 1 else 0 end))::double / (2 * ns) else 0.0::double end"
_SETS = rf"list_transform(s, lambda x: list_distinct(regexp_extract_all(lower(x), '{_W}')))"
_COHERENCE = f"""case when ns < 2 then 0.5::double else coalesce(list_avg(list_filter(list_transform(range(1, ns), lambda i: case when len(({_SETS})[i]) > 0 and len(({_SETS})[i + 1]) > 0
        then len(list_intersect(({_SETS})[i], ({_SETS})[i + 1]))::double / (len(({_SETS})[i]) + len(({_SETS})[i + 1]) - len(list_intersect(({_SETS})[i], ({_SETS})[i + 1]))) end), lambda v: v is not null)), 0.0::double) end"""


# ---- metrics -----------------------------------------------------------------------------------------


@query
def readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.measured(_docs(spark, sf_dir))
    return m.select("doc_id", *(F.round(f(), 6).alias(n) for n, f in (("fre", M.flesch_reading_ease), ("fk", M.flesch_kincaid_grade), ("smog", M.smog_index), ("ari", M.automated_readability_index), ("fog", M.gunning_fog_index))))


SQL["readability"] = f"""with {_BASE} select doc_id, round({_FRE}, 6) as fre, round({_FK}, 6) as fk,
round(case when ns >= 3 then 1.043::double * sqrt(np * 30.0::double / ns) + 3.1291::double else 0.0::double end, 6) as smog,
round(case when nw > 0 and ns > 0 then greatest(0.0::double, 4.71::double * (length(solid)::double / nw) + 0.5::double * (nw::double / ns) - 21.43::double) else 0.0::double end, 6) as ari,
round(case when nw > 0 and ns > 0 then 0.4::double * (nw::double / ns + 100.0::double * nc / nw) else 0.0::double end, 6) as fog from m"""


@query
def text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.measured(_docs(spark, sf_dir))
    return m.select("doc_id", "n_words", "n_sentences", "n_pieces", "n_syllables", "n_poly", "n_complex", "n_solid")


SQL["text_counts"] = f"with {_BASE} select doc_id, nw as n_words, ns as n_sentences, pieces as n_pieces, nsy::bigint as n_syllables, np as n_poly, nc as n_complex, length(solid) as n_solid from m"


@query
def lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.measured(_docs(spark, sf_dir))
    return m.select("doc_id", *(F.round(c, 6).alias(n) for n, c in (("richness", M.vocabulary_richness()), ("bigrams", M.ngram_diversity(2)), ("trigrams", M.ngram_diversity(3)), ("repetitiveness", M.repetitiveness()))))


SQL["lexical"] = f"with {_BASE} select doc_id, round({_VR}, 6) as richness, round({_gram(2)}, 6) as bigrams, round({_gram(3)}, 6) as trigrams, round({_REP}, 6) as repetitiveness from m"


@query
def language_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.measured(_docs(spark, sf_dir))
    return m.select("doc_id", *(F.round(c, 6).alias(n) for n, c in (("spelling", M.spelling_error_ratio()), ("punctuation", M.punctuation_quality()), ("coherence", M.coherence()))))


SQL["language_quality"] = f"with {_BASE} select doc_id, round({_SPELL}, 6) as spelling, round({_PUNCT}, 6) as punctuation, round({_COHERENCE}, 6) as coherence from m"


@query
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.all_metrics(_docs(spark, sf_dir)).select("doc_id", F.round("quality_score", 5).alias("quality_score"))


_SCORE = f"""q as (select doc_id, t, case when regexp_replace(t, '^{_B}+|{_B}+$', '', 'g') = '' then 0.0::double else greatest(0.0::double, least(1.0::double,
0.3::double * ({_FRE} / 100 + greatest(0.0::double, 1 - abs({_FK} - 10) / 10)) / 2 + 0.3::double * ({_VR} + {_gram(2)} + (1 - {_REP})) / 3
+ 0.4::double * ((1 - {_SPELL}) + {_PUNCT} + {_COHERENCE}) / 3)) end as quality_score from m)"""
SQL["quality_score"] = f"with {_BASE}, {_SCORE} select doc_id, round(quality_score, 5) as quality_score from q"


@query
def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a quality of at least 0.6, by source."""
    kept = FL.quality_filter(_docs(spark, sf_dir), 0.6)
    return kept.groupBy("source").agg(F.count("*").alias("docs"))


SQL["quality_filter"] = f"with {_BASE}, {_SCORE} select source, count(*) as docs from documents d left join q using (doc_id) where d.text is null or quality_score >= 0.6 group by source"


@query
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, least and largest value of each metric over all documents."""
    m = M.measured(_docs(spark, sf_dir)).select(M.flesch_reading_ease().alias("flesch_reading_ease"), M.vocabulary_richness().alias("vocabulary_richness"), M.spelling_error_ratio().alias("spelling_error_ratio"))
    return S.metric_summary(m, ["flesch_reading_ease", "vocabulary_richness", "spelling_error_ratio"])


SQL["metric_summary"] = f"""with {_BASE}, v as (select {_FRE} as a, {_VR} as b, {_SPELL} as c from m)
select 'flesch_reading_ease' as metric, round(avg(a), 6) as mean, round(min(a), 6) as min, round(max(a), 6) as max from v
union all select 'vocabulary_richness', round(avg(b), 6), round(min(b), 6), round(max(b), 6) from v
union all select 'spelling_error_ratio', round(avg(c), 6), round(min(c), 6), round(max(c), 6) from v"""


@query
def lexical_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward MTLD."""
    return _docs(spark, sf_dir).filter("text is not null").select("doc_id", F.round(M.lexical_diversity("text"), 6).alias("mtld"))


_SEEN = "case when list_contains(a.seen, e.w) then a.seen else list_append(a.seen, e.w) end"
_FULL = f"(len({_SEEN})::double / (a.n + 1) <= 0.72)"
SQL["lexical_diversity"] = rf"""with w as (select doc_id, regexp_extract_all(lower(text), '{_W}') as lw from documents where text is not null),
f as (select doc_id, lw, list_reduce(list_prepend({{'w': '', 'seen': []::varchar[], 'n': 0::bigint, 'runs': []::bigint[]}}, list_transform(lw, lambda x: {{'w': x, 'seen': []::varchar[], 'n': 0::bigint, 'runs': []::bigint[]}})),
        lambda a, e: {{'w': e.w, 'seen': case when {_FULL} then []::varchar[] else {_SEEN} end, 'n': case when {_FULL} then 0 else a.n + 1 end, 'runs': case when {_FULL} and a.n + 1 >= 10 then list_append(a.runs, a.n + 1) else a.runs end}}) as z from w),
r as (select doc_id, lw, case when z.n >= 10 then list_append(z.runs, z.n) else z.runs end as runs from f)
select doc_id, round(case when len(lw) < 50 or len(runs) = 0 then 0.0::double else list_sum(runs)::double / len(runs) end, 6) as mtld from r"""


@query
def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.measured(_docs(spark, sf_dir)).select("doc_id", F.round(M.perplexity(), 5).alias("perplexity"), (M.perplexity() <= 1000).alias("kept"))
    return m.filter("perplexity < double('infinity')")


SQL["perplexity"] = f"with {_BASE} select doc_id, round(pow(2.0::double, {_ENTROPY}), 5) as perplexity, pow(2.0::double, {_ENTROPY}) <= 1000 as kept from m where nw > 0"


# ---- filters -----------------------------------------------------------------------------------------


@query
def length_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that pass each unit's length rule."""
    fs = [FL.length_filter(10, 10000), FL.length_filter(20, 1000, "words"), FL.length_filter(3, 100, "sentences")]
    return FL.composite_statistics(_docs(spark, sf_dir), fs).select("filter", "original", "filtered", "removed", F.round("removal_rate", 6).alias("removal_rate"))


_UNITS = rf"""l as (select *, text is null or length(text) between 10 and 10000 as k1, text is null or len(regexp_extract_all(text, '{_W}')) between 20 and 1000 as k2,
text is null or len(regexp_split_to_array(regexp_replace(text, '^{_B}+|{_B}+$', '', 'g'), '[.!?]+')) between 3 and 100 as k3 from documents)"""
_ROWS = "select {0} as filter, count(*) as original, count(*) filter (where {1}) as filtered, count(*) - count(*) filter (where {1}) as removed, round((count(*) - count(*) filter (where {1}))::double / count(*), 6) as removal_rate from {2}"
SQL["length_filters"] = f"with {_UNITS} " + " union all ".join(_ROWS.format(f"'{n}'", k, "l") for n, k in (("length_characters", "k1"), ("length_words", "k2"), ("length_sentences", "k3"), ("and", "k1 and k2 and k3")))


@query
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).filter("text is not null").select("doc_id", F.round(FL.toxicity(F.col("text")), 6).alias("toxicity"))


_TOXIC = ", ".join(f"'{w}'" for w in FL.TOXIC)
_TOX = rf"case when len(regexp_extract_all(lower(text), '{_W}')) > 0 then len(list_filter(regexp_extract_all(lower(text), '{_W}'), lambda x: x in ({_TOXIC})))::double / len(regexp_extract_all(lower(text), '{_W}')) else 0.0::double end"
SQL["toxicity"] = f"select doc_id, round({_TOX}, 6) as toxicity from documents where text is not null"


@query
def toxicity_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic labels against the filter's verdict."""
    scored = _docs(spark, sf_dir).filter("text is not null").select("doc_id", (FL.toxicity(F.col("text")) > 0).alias("flagged"))
    return scored.join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id").groupBy("toxic", "flagged").agg(F.count("*").alias("docs"))


SQL["toxicity_by_label"] = f"select toxic, {_TOX} > 0 as flagged, count(*) as docs from documents join labels using (doc_id) where text is not null group by 1, 2"


@query
def content_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).filter("text is not null").select("doc_id", F.inline(F.array(FL.content_type(F.col("text")))))


SQL["content_type"] = "select doc_id, case " + " ".join(f"when regexp_matches(lower(text), '{p}') then '{n}'" for n, p, _ in FL.CONTENT_TYPES) + " else 'general' end as type, case " + " ".join(f"when regexp_matches(lower(text), '{p}') then {c}::double" for _, p, c in FL.CONTENT_TYPES) + " else 0.5::double end as confidence from documents where text is not null"


@query
def filter_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = FL.FilterPipeline().add_filter(FL.length_filter(10, 10000)).add_filter(FL.toxicity_filter(0.0)).add_filter(FL.content_type_filter(["recipe", "news", "academic", "review"]))
    return p.statistics(_docs(spark, sf_dir)).withColumn("removal_rate", F.round("removal_rate", 6))


_CT = "(" + SQL["content_type"].split(" from documents")[0].split("select doc_id, ")[1].split(" as type")[0] + ")"
SQL["filter_pipeline"] = f"""with k as (select text is null or length(text) between 10 and 10000 as a, text is null or {_TOX} <= 0 as b, text is null or {_CT} in ('recipe', 'news', 'academic', 'review') as c from documents),
n as (select count(*) as n0, count(*) filter (where a) as n1, count(*) filter (where a and b) as n2, count(*) filter (where a and b and c) as n3 from k)
select 1::bigint as step, 'length_characters' as filter, n0 as original, n1 as filtered, n0 - n1 as removed, round((n0 - n1)::double / n0, 6) as removal_rate from n
union all select 2, 'toxicity', n1, n2, n1 - n2, round((n1 - n2)::double / n1, 6) from n union all select 3, 'content_type', n2, n3, n2 - n3, round((n2 - n3)::double / n2, 6) from n"""


@query
def composite_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    fs = [FL.length_filter(2000), FL.content_type_filter(["recipe"])]
    return FL.composite_statistics(_docs(spark, sf_dir), fs, "or").withColumn("removal_rate", F.round("removal_rate", 6))


SQL["composite_or"] = f"with k as (select text is null or length(text) >= 2000 as a, text is null or {_CT} = 'recipe' as b from documents) " + " union all ".join(_ROWS.format(f"'{n}'", c, "k") for n, c in (("length_characters", "a"), ("content_type", "b"), ("or", "a or b")))


@query
def language_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected language, over all documents."""
    return _docs(spark, sf_dir).select(detect_language(F.col("text")).alias("detected")).groupBy("detected").agg(F.count("*").alias("docs"))


def _votes(lang: str) -> str:
    return f"len(list_filter(lw, lambda x: x in ({', '.join(repr(w) for w in FUNCTION_WORDS[lang])})))"


_STRIPPED = f"regexp_replace(text, '^{_B}+|{_B}+$', '', 'g')"
_VOTED = rf"v as (select doc_id, text, regexp_extract_all(lower(text), '{_W}') as lw from documents)"
SQL["language_vote"] = f"""with {_VOTED}, n as (select text, [{', '.join(f"{{'n': -{_votes(lang)}, 'lang': '{lang}'}}" for lang in FUNCTION_WORDS)}] as votes from v)
select case when length({_STRIPPED}) >= 50 then list_sort(list_filter(votes, lambda v: v.n < 0))[1].lang end as detected, count(*) as docs from n group by 1"""


@query
def language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which half of the votes are for German or English, and those too short to tell."""
    return FL.language_filter(["de", "en"], 0.5).apply(_docs(spark, sf_dir)).select("doc_id")


SQL["language_filter"] = f"""with {_VOTED}, n as (select doc_id, text, {_votes("de")} as de, {_votes("en")} as en, {' + '.join(map(_votes, FUNCTION_WORDS))} as total from v)
select doc_id from n where text is null or length({_STRIPPED}) < 50 or total = 0 or greatest(de, en)::double / total >= 0.5"""


# ---- cleaning ----------------------------------------------------------------------------------------


@query
def clean_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control characters, addresses and white space; length and digest of what is left."""
    t = collapse_blanks(remove_emails(remove_urls(remove_control(F.col("text")))))
    return _docs(spark, sf_dir).filter("text is not null").select("doc_id", t.alias("t")).select("doc_id", F.length("t").cast("long").alias("chars"), F.sha2("t", 256).alias("digest"))


SQL["clean_basic"] = rf"""with c as (select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '{URL}', '', 'g'), '{EMAIL}', '', 'g'), '{_B}+', ' ', 'g'), '^{_B}+|{_B}+$', '', 'g') as t from documents where text is not null)
select doc_id, length(t) as chars, sha256(t) as digest from c"""


@query
def clean_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own patterns in order, then white space; texts of 200 to 2,000 characters are kept."""
    own = TextCleaner(remove_html=False, fix_encoding=False, normalize_unicode=False, min_length=200, max_length=2000, custom_patterns={"[0-9]+": "0", r"\(([^()]*)\)": r"[\1]", "[$]": "USD$"})
    return own.clean(_docs(spark, sf_dir).filter("text is not null").select("doc_id", "text"), ("text",)).select("doc_id", F.sha2("text", 256).alias("digest"))


SQL["clean_patterns"] = rf"""with c as (select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '[0-9]+', '0', 'g'), '\(([^()]*)\)', '[\1]', 'g'), '[$]', 'USD$', 'g'), '{_B}+', ' ', 'g'), '^{_B}+|{_B}+$', '', 'g') as t from documents where text is not null)
select doc_id, sha256(t) as digest from c where length(t) between 200 and 2000"""


@query
def clean_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain with HTML, encoding and normal forms."""
    return TextCleaner(min_length=20, remove_urls=True, remove_emails=True).statistics(_docs(spark, sf_dir))


# ---- tokens ------------------------------------------------------------------------------------------


@query
def simple_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.process(_docs(spark, sf_dir), K.SimpleTokenizer(), 200).select("doc_id", "num_tokens", "truncated")


_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')"
SQL["simple_tokens"] = f"select doc_id, least(len({_TOKENS}), 200) as num_tokens, len({_TOKENS}) > 200 as truncated from documents where text is not null"


@query
def token_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.statistics(K.process(_docs(spark, sf_dir), K.SimpleTokenizer(), 200)).withColumn("avg_tokens", F.round("avg_tokens", 6)).withColumn("truncation_rate", F.round("truncation_rate", 6))


SQL["token_statistics"] = f"""with t as (select len({_TOKENS}) as n from documents where text is not null)
select count(*) as texts, sum(least(n, 200))::bigint as total_tokens, round(avg(least(n, 200)), 6) as avg_tokens, min(least(n, 200)) as min_tokens, max(least(n, 200)) as max_tokens, count(*) filter (where n > 200) as truncated, round(count(*) filter (where n > 200)::double / count(*), 6) as truncation_rate from t"""


@query
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of the 500 ids of the tokenizer."""
    return K.SimpleTokenizer(500).train(_docs(spark, sf_dir))


SQL["vocabulary"] = f"""with c as (select unnest({_TOKENS}) as token from documents where text is not null), n as (select token, count(*) as n from c group by token order by n desc, token limit 496)
select token, n, row_number() over (order by n desc, token) + 3 as id from n union all select * from (values ('<pad>', 0, 0), ('<unk>', 0, 1), ('<bos>', 0, 2), ('<eos>', 0, 3))"""


@query
def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document: how many, how many unknown, and their sum."""
    tokenizer = K.SimpleTokenizer(500)
    docs = _docs(spark, sf_dir)
    tokenizer.train(docs)
    ids = tokenizer.encode(docs).filter("ids is not null")
    return ids.select("doc_id", T.count(F.col("ids")).alias("tokens"), T.count(F.filter("ids", lambda x: x == 1)).alias("unknown"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"))


SQL["encoded"] = f"""with c as (select doc_id, unnest({_TOKENS}) as token from documents where text is not null), n as (select token, count(*) as n from c group by token order by n desc, token limit 496),
v as (select token, row_number() over (order by n desc, token) + 3 as id from n),
e as (select c.doc_id, coalesce(v.id, 1) as id from c left join v using (token))
select d.doc_id, count(e.id) as tokens, count(*) filter (where e.id = 1) as unknown, coalesce(sum(e.id), 0)::bigint as id_sum from documents d left join e using (doc_id) where d.text is not null group by d.doc_id"""


# ---- duplicates --------------------------------------------------------------------------------------


@query
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.exact_dedup(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id")


SQL["exact_dedup"] = "select doc_id from documents where text is null union all select min(doc_id) from documents where text is not null group by text"


@query
def exact_dedup_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    return D.dedup_statistics(docs, D.exact_dedup(docs)).withColumn("removal_rate", F.round("removal_rate", 6))


SQL["exact_dedup_statistics"] = f"with k as ({SQL['exact_dedup']}), n as (select (select count(*) from documents) as a, (select count(*) from k) as b) select a as original, b as kept, a - b as removed, round((a - b)::double / a, 6) as removal_rate from n"


@query
def char_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).filter("text is not null").select("doc_id", T.count(D.shingles(F.col("text"))).alias("shingles"))


SQL["char_shingles"] = f"""with n as (select doc_id, lower(regexp_replace(regexp_replace(text, '^{_B}+|{_B}+$', '', 'g'), '{_B}+', ' ', 'g')) as t from documents where text is not null)
select doc_id, case when length(t) >= 3 then len(list_distinct(list_transform(range(1, length(t) - 1), lambda i: t[i:i + 2]))) else 0 end as shingles from n"""


@query
def word_set_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of equal word sets at least 0.8 alike."""
    return D.word_set_pairs(_docs(spark, sf_dir).select("doc_id", "text"), 0.8).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


_SET = rf"list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(lower(text), '{_B}+', ' ', 'g'), '[^\p{{L}}\p{{N}}_ ]', '', 'g'), '^{_B}+|{_B}+$', '', 'g'), ' '), lambda x: x <> '')))"
SQL["word_set_pairs"] = f"""with s as (select doc_id, {_SET} as w from documents where text is not null), c as (select min(doc_id) as id, w, len(w) as n from s group by w),
u as (select id, n, unnest(w) as x from c), p as (select a.id as a, b.id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as k from u a join u b on a.x = b.x and a.id < b.id and least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) group by 1, 2)
select a, b, round(k::double / (na + nb - k), 6) as jaccard from p where k::double / (na + nb - k) >= 0.8"""


@query
def word_set_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document."""
    members, _ = D.word_set_classes(_docs(spark, sf_dir).select("doc_id", "text"))
    return members.select("doc_id", "class_id")


SQL["word_set_members"] = f"with s as (select doc_id, {_SET} as w from documents where text is not null) select doc_id, min(doc_id) over (partition by w) as class_id from s"


@query
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents kept by first-wins over word overlap and length."""
    return D.content_dedup(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id")


def _first_wins_sql(words: str, length_ratio: float, similar: str, empty: str) -> str:
    """Pairs in the order of the later document; one falls where an earlier one that has not fallen is similar."""
    return f"""with s as (select doc_id, length(text) as n, {words} as w from documents where text is not null), u as (select doc_id, n, len(w) as k, unnest(w) as x from s),
j as (select a.doc_id as a, b.doc_id as b, any_value(a.k) as ka, any_value(b.k) as kb, count(*) as c from u a join u b on a.x = b.x and a.doc_id < b.doc_id and least(a.k, b.k) >= 0.9 * greatest(a.k, b.k) - 1e-9 and least(a.n, b.n) >= {length_ratio} * greatest(a.n, b.n) group by 1, 2),
p as (select a, b from j where c::double / (ka + kb - c) {similar} {empty}),
f as (select list_reduce(list_prepend([]::bigint[], list([a, b] order by b, a)), lambda fallen, e: case when list_contains(fallen, e[1]) then fallen else list_append(fallen, e[2]) end) as fallen from p)
select doc_id from documents, f where not coalesce(list_contains(fallen, doc_id), false)"""


SQL["content_dedup"] = _first_wins_sql(_SET, 0.8, "> 0.9 + 1e-12", "union select a.doc_id, b.doc_id from s a join s b on a.n = 0 and b.n = 0 and a.doc_id < b.doc_id")


@query
def minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.minhash_dedup(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id")


@query
def duplicate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FL.duplicate_filter(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id")


SQL["duplicate_filter"] = _first_wins_sql(f"list_distinct(regexp_extract_all(lower(text), '{_W}'))", 0.0, ">= 0.9 - 1e-12", "")


# ---- validation and statistics -----------------------------------------------------------------------


@query
def field_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.field_statistics(_docs(spark, sf_dir))


_DOC_FIELDS = (("doc_id", "integer"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "integer"), ("title", "string"), ("format", "string"), ("topic", "string"), ("line_number", "integer"), ("added_at", "string"))
SQL["field_statistics"] = " union all ".join(
    f"select '{f}' as field, '{k}' as type, count({f}) as present, round(count({f})::double / count(*), 6) as presence, "
    + (f"min(length({f})) as min_length, max(length({f})) as max_length, round(avg(length({f})), 6) as avg_length, list_sort(list(length({f})) filter (where {f} is not null))[(count({f}) // 2) + 1] as median_length" if k == "string" and f != "added_at" else "null::bigint as min_length, null::bigint as max_length, null::double as avg_length, null::bigint as median_length")
    + " from documents"
    for f, k in _DOC_FIELDS
)


@query
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.dataset_statistics(_docs(spark, sf_dir), ("text", "title"))


SQL["coverage"] = " union all ".join(
    f"select '{f}' as field, round(count({f})::double / count(*), 6) as coverage, "
    + (f"min(length({f})) as min_length, max(length({f})) as max_length, round(avg(length({f})), 6) as avg_length, sum(length({f}))::bigint as total_length" if f in ("text", "title") else "null::bigint as min_length, null::bigint as max_length, null::double as avg_length, null::bigint as total_length")
    + " from documents"
    for f, _ in _DOC_FIELDS
)


@query
def validation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.error_summary(V.validate(_docs(spark, sf_dir), required=["doc_id", "text", "source"]))


SQL["validation_errors"] = rf"""with e as (select case when text is null then 'Required field is None' end as error from documents union all select case when source is null then 'Required field is None' end from documents
union all select case when regexp_replace(text, '^{_B}+|{_B}+$', '', 'g') = '' then 'Empty text field' end from documents union all select case when regexp_replace(title, '^{_B}+|{_B}+$', '', 'g') = '' then 'Empty text field' end from documents
union all select case when regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]') then 'Control characters in field' end from documents union all select case when regexp_matches(title, '[\x00-\x08\x0B\x0C\x0E-\x1F]') then 'Control characters in field' end from documents
union all select case when len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 10000)) > 0 then 'Very long lines in field' end from documents)
select error, count(*) as count from e where error is not null group by error"""


# ---- splits ------------------------------------------------------------------------------------------


@query
def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.random_split(_docs(spark, sf_dir).select("doc_id")).select("doc_id", "split")


SQL["random_split"] = """with r as (select doc_id, row_number() over (order by sha256('42:' || doc_id), doc_id) - 1 as r, count(*) over () as n from documents)
select doc_id, case when r < floor(n * 0.8::double + 1e-9) then 'train' when r < floor(n * 0.8::double + 1e-9) + floor(n * 0.1::double + 1e-9) then 'validation' else 'test' end as split from r"""


@query
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stratified_split(_docs(spark, sf_dir).select("doc_id", "lang"), "lang").select("doc_id", "split")


SQL["stratified_split"] = """with r as (select doc_id, row_number() over (partition by coalesce(lang, '_missing_') order by sha256('42:' || doc_id), doc_id) - 1 as r, count(*) over (partition by coalesce(lang, '_missing_')) as n from documents)
select doc_id, case when r < floor(n * 0.8::double + 1e-9) then 'train' when r < floor(n * 0.8::double + 1e-9) + floor(n * 0.1::double + 1e-9) then 'validation' else 'test' end as split from r"""


@query
def random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampling operator: 100 documents, drawn by seed."""
    return S.sample(_docs(spark, sf_dir).select("doc_id"), 100)


SQL["random_sample"] = "select doc_id from documents order by sha256('42:' || doc_id), doc_id limit 100"


@query
def newest_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 3 by time for each source."""
    d = _docs(spark, sf_dir).select("doc_id", "source", "added_at").filter("source is not null")
    ranked = d.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("added_at"), "doc_id")))
    return ranked.filter("k <= 3").select("doc_id", "source", F.col("k").cast("long").alias("k"))


SQL["newest_per_source"] = "select doc_id, source, row_number() over (partition by source order by added_at desc, doc_id) as k from documents where source is not null qualify k <= 3"
