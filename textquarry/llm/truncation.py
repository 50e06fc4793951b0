"""Texts cut off by field limits or in transfer.

Method, in SQL throughout, over whole texts: word trigrams are counted over all texts, inside sentences and at their ends. The last
trigram of every text that stops without an end mark is joined with these counts: frequent inside and almost never at
an end means that the sentence was going on. A last word that is only the beginning of the words that usually follow
means that the word was. Lengths at which a source stops again and again tell its field limits.
"""

from __future__ import annotations

from itertools import groupby
from operator import itemgetter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.shape import FURNITURE
from textquarry.runtime import materialize

#: A trigram (or a pair of words, where the trigram is rarer) is frequent from this count inside sentences.
FREQUENT = 3
#: Largest share of ends among its uses for a trigram that almost never ends a sentence.
RARELY_ENDS = 0.1
#: Texts of exactly one length that make it a field limit of their source, as a count and as a share.
LIMIT_TEXTS, LIMIT_SHARE = 5, 0.04
#: A cut at the last blank before a limit, or a note put behind it, moves the end of a text by so many characters at most.
NEAR_LIMIT = 60
#: A last line of so many characters at most is a heading, entry or name, which a writer may end without a mark.
BRIEF_LINE = 44

_TOKEN = r"[\\p{L}\\p{N}]++(?:[\\x27’-][\\p{L}\\p{N}]++)*+|[.!?\\n]"
_MARKS = "('.', '!', '?', '\\n')"

#: Counts of every trigram: followed by a word, or by an end mark or a line's end. A sentence's start stands for the words before it.
TRIGRAMS = rf"""
select case when w2 in {_MARKS} or w1 in {_MARKS} then '¶' else w1 end as w1, case when w2 in {_MARKS} then '¶' else w2 end as w2, w3,
       sum(case when w4 in {_MARKS} then 0 else 1 end) as inside, sum(case when w4 in {_MARKS} then 1 else 0 end) as ends
from (select z.t as w1, z.`1` as w2, z.`2` as w3, z.`3` as w4
      from (select explode(arrays_zip(t, slice(t, 2, size(t)), slice(t, 3, size(t)), slice(t, 4, size(t)))) as z
            from (select concat(array('.', '.'), regexp_extract_all(lower(text), '{_TOKEN}', 0)) as t from {{docs}} where text is not null)))
where w3 is not null and w4 is not null and w3 not in {_MARKS}
group by 1, 2, 3
"""

#: (signs without one of which nothing is to be cleared, (pattern of markup, what it leaves) in order)
_CLEAN = (
    (("<",), ((r"(?s)<(style|script)\\b.*?(?:</\\1>|$)|<!--.*?-->", ". "),)),
    (("`",), ((r"(?s)```.*?(?:```|$)", ". "),)),
    (("\\\\",), ((r"(?s)\\\\begin\\{[a-z]*\\}.*?\\\\end\\{[a-z]*\\}", ". "),)),
    (
        ("[",),
        (
            (r"!\\[[^\\]\\n]*\\]\\([^)\\s]*\\)", ". "),
            (r"\\[([^\\]\\n]*)\\]\\([^)\\s]*\\)", "$1"),
            (r"\\[\\[(?:Category|File|Kategorie|Categoría|Catégorie|Categoria|Categorie|Категория):[^\\]]*\\]\\]", "."),
        ),
    ),
    (("\\\\",), ((r"~?\\\\(?:cite|label|ref|footnote)\\w*\\{[^}]*\\}", ""),)),
    (("<",), ((r"<ref[^>]*>.*?</ref>", ""),)),
    (("://", "www", "@"), ((r"(?:https?://|www\\.)\\S+|(?<![^\\s@])[^\\s@]++@[^\\s@]+\\.\\w+", "."),)),
    (("<", "lt;"), ((r"</?[A-Za-z][^<>]*>", ""), (r"&(?:amp;)?lt;/?[A-Za-z](?:[^<>&]|&(?!(?:amp;)?[lg]t;))*&(?:amp;)?gt;", ""))),
)


def _cleaned(column: str) -> str:
    """Views in which the last, ``clean``, is the column without markup; each is worked out once and only where its signs are."""
    views = []
    for i, (signs, patterns) in enumerate(_CLEAN):
        out = column
        for pattern, new in patterns:
            out = f"regexp_replace({out}, '{pattern}', '{new}')"
        name = f"clean_{i}" if i < len(_CLEAN) - 1 else "clean"
        views.append(f"lateral view explode(array(if({' or '.join(f"contains({column}, '{x}')" for x in signs)}, {out}, {column}))) as {name}")
        column = name
    return "\n".join(views)


_WORD = r"[\\p{L}\\p{N}]+(?:[\\x27’-]\\p{L}+)*"
#: Both are looked for in a text read backwards, where its end comes first and patterns need no search.
_DOTS = r"^[\\])\\s]*+(?:…|\\.\\.\\.)"
_ENDED = r"^[^\\p{L}\\p{N}]*?(?:.?€â)?[.!?]"

#: Texts whose end, as it stands, is no end of a sentence; the usual ends are told by their last sign.
OPEN_ENDED = rf"""
select doc_id, source, length(text) as chars, octet_length(text) as bytes, text from {{docs}}
where text is not null and not (endswith(text, '.') and not endswith(text, '...')) and not endswith(text, '?') and not endswith(text, '!') and (reverse(text) rlike '{_DOTS}' or not reverse(text) rlike '{_ENDED}')
"""

#: (pattern of tags, what it leaves for lines and cells)
_TAGS = (
    (r"&(?:amp;)?lt;(/?[A-Za-z!](?:[^<>&]|&(?!(?:amp;)?[lg]t;))*)&(?:amp;)?gt;", "<$1>"),
    (r"(?s)<!--.*?-->", " "),
    (r"(?i)<(?:li|dt|dd)\\b[^<>]*>", r"\n- "),
    (r"(?i)</t[dh]\\s*>\\s*(?=<t[dh])", r"\t"),
    (r"(?i)</?(?:li|tr|p|div|ul|ol|table|h[1-6]|br|hr|dt|dd|section|article|blockquote)\\b[^<>]*>", r"\n"),
    (r"</?[A-Za-z][^<>]*>|&#?\\w{2,31};", " "),
)
_SET_UP = r"^\\s*(?:\\{\\||\\|\\}|\\|-|\\|?[\\s:|-]+\\|?$|\\\\(?:begin|end)\\{[^}]*\\}.*$|\\\\hline|\\\\(?:top|mid|bottom)rule|```\\w*$)"
_MARK = r"^\\s*(?:[-*+•·–—▪◦‣o]\\s+|\\*+\\s*|#+\\s*(?=\\[\\[)|\\(?\\d{1,3}[.)\\]:]\\s+|\\(\\d{1,3}\\)|\\(?[A-Za-zа-я][.)]\\s+|\\[\\d{1,3}\\]\\s+|\\\\item\\b|[ivxIVX]{1,5}[.)]\\s+|[A-Z]\\d?[.:]\\s+|\\[[ xX]\\]\\s+)"
_ENDS = r"[.!?…。][\\x27\"”’»)\\]*_~]*\\s*(?:\\\\\\\\|\\[\\d+\\]|~?\\\\cite\\{[^}]*\\})?\\s*$"
_LOG = r"\\b\\w+=[\\w./:-]+|\\d{4}-\\d\\d-\\d\\d[ T]\\d\\d:\\d\\d|\\b(?:INFO|WARN|ERROR|DEBUG)\\b"
#: Words of page furniture, in lower case and by their first letters, so that most words are passed over at once.
_FURNITURE = rf"\\b(?:{'|'.join(f'{c}(?:{"|".join(w[1:] for w in ws)})' for c, ws in groupby(sorted(FURNITURE), key=itemgetter(0)))})\\b"
_HEADING = r"^\\s*(?:#{1,6}\\s|={2,}.*={2,}\\s*$|\\\\(?:sub)*section)"
#: Words that no language has: overlong, letters among digits, or six consonants in a row.
_ODD = r"(?i)(?<![\\p{L}\\p{N}])(?=[\\p{L}\\p{N}]{5})(?:[\\p{L}\\p{N}]{23,}|(?=\\p{L}*\\p{N}+\\p{L}|\\p{L}+\\p{N})[\\p{L}\\p{N}]+|\\p{L}*[bcdfghjklmnpqrstvwxzбвгджзйклмнпрстфхцчшщъь]{6}\\p{L}*)"

#: What a line y.x of y.words words, which an end mark closes or not, is by its signs and words, as in problem 4: a row of cells, an entry, a short line,
#: running text or odd. The usual case comes first.
_LINE_KIND = rf"""case
 when y.words >= 12 and y.ended and not y.x rlike '[|\t]| & ' then 'prose'
 when (y.x rlike '=|\\d:\\d' and regexp_count(y.x, '{_LOG}') >= 2) or (y.x rlike '^[^\\p{{L}}\\t|,;]*$' and not y.x rlike ' {{2,}}') then 'odd'
 when not y.ended and regexp_count(lower(y.x), '{_FURNITURE}') >= 0.25 * y.words then 'odd'
 when regexp_count(y.x, '\\|') >= 2 or y.x rlike '\\|\\||!!|^\\s*\\|' or y.x rlike '\\s&\\s.*(?:\\\\\\\\|\\\\hline)\\s*$' then 'table'
 when trim(y.x) like '%\t%' and y.words < 8 * (1 + regexp_count(trim(y.x), '\\t+')) then 'table'
 when y.ended then if(y.x rlike '{_MARK}' and y.words <= 9, 'list', 'prose')
 when y.x like '%  %' and regexp_count(trim(y.x), '(?<=\\S) {{2,}}(?=\\S)') >= 2 and regexp_count(trim(y.x), ' {{2,}}') * 2 >= regexp_count(trim(y.x), '(?<! ) (?! )') then 'table'
 when not y.x rlike '[,;] ' and greatest(regexp_count(y.x, ',(?! )'), regexp_count(y.x, ';(?! )')) >= 2 then 'table'
 when y.words <= 16 and y.x rlike '{_MARK}' then 'list'
 when y.x like '%; %; %' and not exists(split(y.x, ';'), z -> size(split(trim(z), '\\s+')) > 8) then 'list'
 when regexp_count(y.x, '{_ODD}') > 0.3 * y.words then 'odd'
 when y.x rlike '{_HEADING}' then 'prose'
 when y.words <= 7 then 'short' else 'prose' end"""

#: Texts most of whose words run in sentences; four and more short lines are an enumeration, and a few words over and
#: over are junk. Each view holds a value that is worked out once, however often it is used.
PROSE = rf"""
select doc_id, source, chars, bytes, text
from {{ends}} lateral view explode(array({{plain}})) as plain
lateral view explode(array(filter(split(plain, '[\\r\\n]+'), x -> x rlike '\\S' and not x rlike '{_SET_UP}'))) as lines
lateral view explode(array(transform(lines, x -> named_struct('x', x, 'ended', x rlike '{_ENDS}', 'words', if(x rlike '\\p{{L}}', regexp_count(x, '{_WORD}'), size(split(trim(x), '\\s+'))))))) as counts
lateral view explode(array(transform(counts, y -> named_struct('k', {_LINE_KIND}, 'w', y.words)))) as kinds
lateral view explode(array(aggregate(counts, 0, (a, y) -> a + y.words))) as n
lateral view explode(array(if(n < 12, 99, size(array_distinct(regexp_extract_all(lower(plain), '{_WORD}', 0)))))) as different
where n > 0 and not (different <= 8 and different < 0.4 * n)
  and aggregate(filter(kinds, y -> y.k = 'prose' or (y.k = 'short' and size(filter(kinds, z -> z.k = 'short')) < 4)), 0, (a, y) -> a + y.w) >= 0.5 * n
"""


def _plain(column: str) -> str:
    out = column
    for pattern, new in _TAGS:
        out = f"regexp_replace({out}, '{pattern}', '{new}')"
    return f"case when {column} rlike '<[A-Za-z/!]|&[a-z#]' then {out} else {column} end"


#: The last words of texts that stop without an end mark, or with the dots that some writers of fields put after a cut.
#: The text without markup is read backwards: its last tokens come first, however long the text or its last sentence is.
#: Each view holds a value that is worked out once, however often it is used.
FINALS = rf"""
select doc_id, source, chars, bytes,
       case when size(t) < 3 or get(t, size(t) - 2) in {_MARKS} or get(t, size(t) - 3) in {_MARKS} then '¶' else get(t, size(t) - 3) end as w1,
       case when size(t) < 2 or get(t, size(t) - 2) in {_MARKS} then '¶' else get(t, size(t) - 2) end as w2, get(t, size(t) - 1) as w3,
       tail rlike '(?:^|\\n)[^\\p{{L}}\\p{{N}}\\n]*[\\p{{L}}\\p{{N}}\\x27’-]+[^\\p{{L}}\\p{{N}}\\n]*$' as alone,
       back rlike '^[^\\p{{L}}\\p{{N}}]*+[^\\n]{{0,{BRIEF_LINE}}}\\n' as brief
from {{ends}} {{clean}}
lateral view explode(array(reverse(trim(trailing ' \t\n\r\u000b\u000c' from clean)))) as back
lateral view explode(array(reverse(regexp_extract(back, '^[^\\p{{L}}\\p{{N}}]*+((?:[^.!?\\n\\p{{L}}\\p{{N}}]*+(?:[\\p{{L}}\\p{{N}}]++(?:[\\x27’-][\\p{{L}}\\p{{N}}]++)*+|[.!?\\n])){{1,6}})', 1)))) as tail
lateral view explode(array(regexp_extract_all(lower(tail), '{_TOKEN}', 0))) as t
where (back rlike '{_DOTS}' or not back rlike '{_ENDED}') and size(t) > 0 and get(t, size(t) - 1) not in {_MARKS}
"""

#: Lengths, in characters and in bytes, beyond which hardly a text of a source goes and at which many of them stop.
LIMITS = """
with lengths as (select source, length(text) as c, octet_length(text) as b, count(*) as n from {docs} where text is not null and source is not null group by 1, 2, 3),
     upto as (select *, sum(n) over (partition by source order by c) as to_c, sum(n) over (partition by source order by b) as to_b, sum(n) over (partition by source) as total from lengths),
     most as (select source, min(case when to_c >= 0.995 * total then c end) as c, min(case when to_b >= 0.995 * total then b end) as b from upto group by source)
select l.source, any_value(m.c) as chars_limit, any_value(m.b) as bytes_limit,
       sum(case when l.c = m.c then l.n else 0 end) >= greatest({texts}, {share} * sum(l.n)) as by_chars,
       sum(case when l.b = m.b then l.n else 0 end) >= greatest({texts}, {share} * sum(l.n)) as by_bytes
from upto l join most m on l.source = m.source group by l.source
"""

#: Trigrams that begin like a final one: all that its own count and the words usual in its place need.
NEAR = "select t.* from {trigrams} t left semi join (select distinct w1, w2 from {finals}) a on t.w1 = a.w1 and t.w2 = a.w2"

#: What is asked of the counts. Longer words in a final word's place are found by their beginnings: the beginnings of
#: words, of the lengths that final words have, are written out beside the words themselves and joined as equal keys.
JUDGED = """
with triples as (select b.w1, b.w2, b.w3, sum(if(own, inside, 0)) as inside, sum(if(own, ends, 0)) as ends, sum(if(own, 0, inside + ends)) as longer
                 from (select w1, w2, left(w3, k) as w3, k = length(w3) as own, inside, ends from (select *, explode({beginnings}) as k from {near})) b
                 left semi join (select distinct w1, w2, w3 from {finals}) a on a.w1 = b.w1 and a.w2 = b.w2 and a.w3 = b.w3 group by b.w1, b.w2, b.w3),
     pairs as (select b.w2, b.w3, sum(if(own, inside, 0)) as inside, sum(if(own, ends, 0)) as ends, sum(if(own, 0, inside + ends)) as longer
               from (select w2, left(w3, k) as w3, k = length(w3) as own, inside, ends
                     from (select *, explode({beginnings}) as k from (select w2, w3, sum(inside) as inside, sum(ends) as ends from {trigrams} where w2 <> '¶' group by w2, w3) p
                           left semi join (select distinct w2 from {finals}) s on p.w2 = s.w2)) b
               left semi join (select distinct w2, w3 from {finals}) a on a.w2 = b.w2 and a.w3 = b.w3 group by b.w2, b.w3),
     words as (select b.w3, sum(if(own, n, 0)) as known, sum(if(own, 0, n)) as longer
               from (select left(w3, k) as w3, k = length(w3) as own, n from (select *, explode({beginnings}) as k from (select w3, sum(inside + ends) as n from {trigrams} group by w3))) b
               left semi join (select distinct w3 from {finals} where length(w3) >= 3) a on a.w3 = b.w3 group by b.w3)
select f.doc_id, f.source,
       not f.alone and (case when coalesce(t.inside + t.ends, 0) >= {frequent} then t.inside >= {frequent} and t.ends <= {rarely} * t.inside
                             else coalesce(p.inside >= {frequent} and p.ends <= {rarely} * p.inside, false) end) as in_sentence,
       coalesce(t.longer >= {frequent} and t.inside + t.ends < {rarely} * t.longer, false)
         or (not f.alone and coalesce(t.longer, 0) < {frequent} and coalesce(p.longer >= {frequent} and p.inside + p.ends < {rarely} * p.longer, false))
         or (not f.alone and f.w1 <> '¶' and coalesce(u.known = 0 and u.longer >= {frequent}, false)) as in_word,
       not f.brief and coalesce((m.by_chars and f.chars between m.chars_limit - {window} + 1 and m.chars_limit) or (m.by_bytes and f.bytes between m.bytes_limit - {window} + 1 and m.bytes_limit), false) as at_limit
from {finals} f
left join triples t on f.w1 = t.w1 and f.w2 = t.w2 and f.w3 = t.w3
left join pairs p on f.w2 = p.w2 and f.w3 = p.w3
left join words u on f.w3 = u.w3
left join {limits} m on f.source = m.source
"""


def _run(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """The query over tables named in braces; other braces, of patterns, are kept."""
    sql = sql.replace("{", "{{").replace("}", "}}")
    for name in tables:
        sql = sql.replace("{{" + name + "}}", "{" + name + "}")
    return spark.sql(sql, **tables)


def unfinished(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, in_sentence, in_word, at_limit of every prose text without an end mark; all three are booleans.

    Lists, tables and junk are left out by the shares of their own words. Null and blank texts give no row; a null source has no field limit; rows that repeat are judged each by itself, and
    count each; other columns are ignored. Sources are compared without letter case and outer blanks.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.trim(F.col(source_col))).alias("source"), F.col(text_col).cast("string").alias("text"))
    trigrams = materialize(_run(spark, TRIGRAMS, docs=docs))
    ends = _run(spark, PROSE.replace("{plain}", _plain("text")), ends=_run(spark, OPEN_ENDED, docs=docs))
    finals = materialize(_run(spark, FINALS.replace("{clean}", _cleaned("text")), ends=ends))
    limits = materialize(_run(spark, LIMITS.replace("{texts}", str(LIMIT_TEXTS)).replace("{share}", str(LIMIT_SHARE)), docs=docs))
    near = _run(spark, NEAR, trigrams=trigrams, finals=finals)
    lengths = finals.agg(F.array_sort(F.collect_set(F.length("w3")))).first()[0]  # different lengths of words
    fixed = {"frequent": FREQUENT, "rarely": RARELY_ENDS, "window": NEAR_LIMIT, "beginnings": f"array_append(filter(cast(array({', '.join(map(str, lengths))}) as array<int>), k -> k < length(w3)), length(w3))"}
    sql = JUDGED
    for name, value in fixed.items():
        sql = sql.replace("{" + name + "}", str(value))
    return _run(spark, sql, finals=finals, trigrams=trigrams, near=near, limits=limits)


def truncated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``unfinished`` that were cut."""
    return unfinished(df, id_col, text_col, source_col).filter("in_sentence or in_word or at_limit")


def rates(df: DataFrame, **columns: str) -> DataFrame:
    """For each source, null included: its texts, how many were cut, and their share."""
    cut = truncated(df, **columns).select("doc_id").distinct().withColumn("cut", F.lit(1))
    ids, source, text = (columns.get(f"{x}_col", x if x != "id" else "doc_id") for x in ("id", "source", "text"))
    all_ = df.select(F.col(ids).cast("long").alias("doc_id"), F.lower(F.trim(F.col(source))).alias("source"), F.col(text).alias("_text")).filter("trim(_text) <> ''").drop("_text")
    by = all_.join(cut, "doc_id", "left").groupBy("source").agg(F.count("*").alias("texts"), F.count("cut").alias("truncated"))
    return by.withColumn("share", F.round(F.col("truncated") / F.col("texts"), 6))
