"""Registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, license_scan, line_dedup, mixing, near_dedup, one_bit_search, prefix_join, quality_rules, secret_scan, toxicity, turn_repair, url_filter
from .common import table

VOCABULARY = "byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL_TWINS: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL_TWINS[fn.__name__] = sql
        return fn

    return register


URL_SQL = r"""
with captures as (
  select page_id, url, cast(ts as date) as fetched_on,
         lower(regexp_replace(regexp_replace(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''),
                              '\.?(:[0-9]*)?$', '')) as host,
         list_filter(string_split(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') as parts
  from pages left join events on event_id = page_id),
entries as (
  select case when event_type in ('error', 'signup') then 'host:' || host else 'path:' || host || '/' || parts[1] end as pattern,
         case when event_type in ('error', 'view') then 'add' else 'remove' end as action, cast(ts as date) as dated_on, event_id as seq
  from events join (select distinct page_id, host, parts from captures) on user_id = page_id),
daily as (select pattern, dated_on, arg_max(action, seq) as action from entries where pattern is not null and dated_on is not null group by 1, 2),
spans as (select *, coalesce(lead(dated_on) over (partition by pattern order by dated_on), date '9999-12-31') as valid_to from daily),
keys as (
  select page_id, fetched_on, unnest(
    list_concat(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: 'host:' || array_to_string(string_split(host, '.')[i:], '.')),
                list_transform(range(1, len(parts) + 1), lambda i: 'path:' || host || '/' || array_to_string(parts[1:i], '/')))) as pattern
  from captures where host <> ''),
hits as (
  select page_id, min(k.pattern) as pattern
  from keys k join spans s on k.pattern = s.pattern and dated_on <= fetched_on and fetched_on < valid_to
  where action = 'add' group by 1)
select page_id, url, fetched_on, pattern is not null as blocked, pattern from captures left join hits using (page_id)
"""


@query(URL_SQL)
def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Pages are fetched on the day of the event of their number; the event log is the change log of the list: errors
    and sign-ups of a user add and remove the host of the page of the user's number, other events its first directory."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    events = table(spark, folder, "events")
    day = F.col("ts").cast("date")
    captures = pages.join(events.select(F.col("event_id").alias("page_id"), day.alias("fetched_on")), "page_id", "left")
    host, part = url_filter.host_of(F.col("url")), F.filter(F.split(url_filter.path_of(F.col("url")), "/"), lambda x: x != "")
    whole = F.col("event_type").isin("error", "signup")
    entries = events.join(pages.withColumnRenamed("page_id", "user_id"), "user_id").select(
        F.when(whole, F.concat(F.lit("host:"), host)).otherwise(F.concat(F.lit("path:"), host, F.lit("/"), F.get(part, 0))).alias("pattern"),
        F.when(F.col("event_type").isin("error", "view"), "add").otherwise("remove").alias("action"),
        day.alias("dated_on"),
        F.col("event_id").alias("seq"),
    )
    return url_filter.block(captures, entries)


@query()
def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.report(table(spark, folder, "documents"))


QUALITY_SQL = r"""
with t as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines
  from documents),
grams as (
  select doc_id, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] as g
  from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from t)),
again as (select doc_id, i from grams qualify count(*) over (partition by doc_id, g) > 1),
repeats as (
  select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from again) group by doc_id),
facts as (
  select t.doc_id, cast(len(words) as bigint) as n_words, cast(length(array_to_string(words, '')) as bigint) as word_chars,
         cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, coalesce(n, 0) as n_repeat_words,
         len(lines) as n_lines, length(text) - length(regexp_replace(text, '[!?]', '', 'g')) as n_marks
  from t left join repeats r using (doc_id)),
base as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from facts)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not (10 * n_symbols > 3 * n_words) and not (word_chars < 2 * n_words or word_chars > 15 * n_words)
         and not (10 * n_dup_lines > 4 * n_lines) and not (100 * n_marks > 8 * word_chars) as kept
from base
"""


@query(QUALITY_SQL)
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents")).drop("rejected_by")



@query()
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")))


@query()
def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY)).drop("ids")


@query()
def op6_lsh_forest(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.groups(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def _licence_sql() -> str:
    names = [license_scan.normalised(s) for s in license_scan.SENTENCES]
    known = ", ".join(f"'{s}'" for s in names)
    # an end is written twice, so that two sentences in a row have one each; words may be apart by an end
    anywhere = "|".join(s.replace(" ", "(?: |\\n\\n)") for s in sorted(names, key=len, reverse=True))
    steps = [
        f"""parts as (
  select doc_id, regexp_replace(regexp_replace(lower(regexp_replace(coalesce(text, ''), '[.!?:;][\\x20\\x09-\\x0D]+|[.!?:;]$|\\n+', chr(10), 'g')),
           '[^a-z0-9\\n]+', ' ', 'g'), ' *\\n[ \\n]*', chr(10) || chr(10), 'g') as t from documents),
t0 as (
  select doc_id, array_to_string(list_transform(ids, lambda i: ',' || i || ','), '') as rest, len(ids) as n, cast([] as varchar[]) as names
  from (select doc_id, list_transform(regexp_extract_all(chr(10) || trim(t) || chr(10), '\\n(?:{anywhere})\\n'),
          lambda s: list_position([{known}], trim(regexp_replace(s, '\\n+', ' ', 'g')))) as ids from parts))"""
    ]
    for k, (name, numbers) in enumerate(license_scan.RULES):
        seq = "," + ",,".join(map(str, numbers)) + ","
        steps.append(
            f"t{k + 1} as (select doc_id, replace(rest, '{seq}', '|') as rest, n, "
            f"case when contains(rest, '{seq}') and not list_contains(names, '{name}') then list_append(names, '{name}') else names end as names from t{k})"
        )
    return "with " + ",\n".join(steps) + f"\nselect doc_id, cast(n as bigint) as n_sentences, array_to_string(names, ',') as licences from t{len(steps) - 1}"


@query(_licence_sql())
def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(table(spark, folder, "documents"))


@query()
def op8_one_bit_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return one_bit_search.nearest(vectors, vectors.where("id % 20 = 0"))


@query()
def op9_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query()
def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scan(table(spark, folder, "documents"))


@query()
def op11_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations")
    return turn_repair.report(conversations, turn_repair.repair(turn_repair.damaged(conversations)))


COLLOCATION_SQL = r"""
with docs as (select coalesce(lang, 'und') as lang,
   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
pieces as (
  select lang, list_filter(string_split_regex(p, '[ \t]+'), lambda x: x <> '') as ws
  from (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as p from docs)),
totals as (select lang, sum(len(ws)) as n from pieces group by lang),
grams as (""" + " union all ".join(
    f"select lang, unnest(list_transform(range(1, len(ws) - {m} + 2), lambda i: ws[i:i + {m - 1}])) as g from pieces where len(ws) >= {m}"
    for m in range(1, 6)
) + r"""),
counts as (select lang, g, count(*) as a from grams group by all having count(*) >= 100),
cand as (select * from counts where len(g) > 1),
inner_parts as (select lang, unnest(flatten(list_transform(range(2, len(g)), lambda m:
   list_transform(range(1, len(g) - m + 2), lambda i: g[i:i + m - 1])))) as g, a from cand where len(g) > 2),
longer as (select lang, g, max(a) as b from inner_parts group by all),
kept as (select c.* from cand c left join longer x using (lang, g) where b is null or 100 * b < 100 * a),
cuts as (select lang, g, a, n, unnest(range(1, len(g))) as k from kept join totals using (lang)),
scored as (
  select c.lang, c.g, c.a, c.n, c.k, x.a as l, y.a as r, (1000::hugeint * c.a * c.n) // (x.a::hugeint * y.a) as score
  from cuts c join counts x on x.lang = c.lang and x.g = c.g[1:c.k] join counts y on y.lang = c.lang and y.g = c.g[c.k + 1:]),
least as (select * from scored qualify row_number() over (partition by lang, g order by score, k) = 1)
select lang, rank::integer as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from (select *, array_to_string(g, ' ') as phrase,
        row_number() over (partition by lang order by score desc, a desc, array_to_string(g, ' ')) as rank from least)
where rank <= 2000
"""


@query(COLLOCATION_SQL)
def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


@query()
def op13_prefix_join(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_join.groups(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")
