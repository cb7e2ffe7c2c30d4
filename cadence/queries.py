"""Queries that apply the operators to whole tables, with the same in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.functions import numbers as N
from cadence.functions import text as T
from cadence.operators import evaluate, policy, resolve, scorer, tokens
from cadence.plans import api
from cadence.sources import lexicon
from cadence.streaming import posts
from cadence.tables import ACRONYM, AMBIGUOUS, EMOJI, INITIALISM, REGISTRY_LABELS, SEED_LEXICON, SLANG, SPELLED_LABELS, TLDS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: What Spark puts into one split of a file, so that a table below this for each core leaves cores idle.
SPLIT_BYTES = 128 << 20


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A table. With spread, for work that costs far more than reading, one too small to give each core a split is dealt to all cores; a larger one is not shuffled."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    small = spread and int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < cores * SPLIT_BYTES
    return rows.repartition(cores) if small else rows


# SQL of the readings, written apart from the Column functions
_ONES = "['zero','one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve','thirteen','fourteen','fifteen','sixteen','seventeen','eighteen','nineteen']"
_TENS = "['','','twenty','thirty','forty','fifty','sixty','seventy','eighty','ninety']"
_MONTHS = "['january','february','march','april','may','june','july','august','september','october','november','december']"


def sql_two(n: str) -> str:
    return f"case when {n} = 0 then '' when {n} < 20 then {_ONES}[{n} + 1] else {_TENS}[{n} // 10 + 1] || case when {n} % 10 > 0 then ' ' || {_ONES}[{n} % 10 + 1] else '' end end"


def sql_three(n: str) -> str:
    return f"trim(case when {n} >= 100 then {_ONES}[{n} // 100 + 1] || ' hundred ' else '' end || {sql_two(f'({n} % 100)')})"


def sql_cardinal(n: str) -> str:
    """Of a column from 0 to 999,999,999."""
    m, k = f"({n} // 1000000)", f"(({n} // 1000) % 1000)"
    return f"case when {n} = 0 then 'zero' else trim(case when {m} > 0 then {sql_three(m)} || ' million ' else '' end || case when {k} > 0 then {sql_three(k)} || ' thousand ' else '' end || {sql_three(f'({n} % 1000)')}) end"


def sql_ordinal(words: str) -> str:
    out = words
    pairs = dict(zip("one two three five eight nine twelve".split(), "first second third fifth eighth ninth twelfth".split()))
    cases = " ".join(f"when {words} = '{a}' or {words} like '% {a}' then substr({words}, 1, length({words}) - {len(a)}) || '{b}'" for a, b in pairs.items())
    return f"case {cases} when {out} like '%y' then substr({words}, 1, length({words}) - 1) || 'tieth' else {words} || 'th' end"


def sql_year(n: str) -> str:
    h, lo = f"({n} // 100)", f"({n} % 100)"
    return (
        f"case when {n} < 1000 or {n} > 2099 or {n} % 1000 = 0 then {sql_cardinal(n)} when {lo} = 0 then {sql_two(h)} || ' hundred' when {n} between 2000 and 2009 then 'two thousand ' || {sql_two(lo)} "
        f"when {lo} < 10 then {sql_two(h)} || ' oh ' || {sql_two(lo)} else {sql_two(h)} || ' ' || {sql_two(lo)} end"
    )


# numbers
@query(f"with t as (select o_orderkey, cast(o_orderkey as bigint) as n, cast(o_custkey as bigint) as c from orders) select o_orderkey, {sql_cardinal('n')} as key_words, case when c > 0 then 'negative ' else '' end || {sql_cardinal('c')} as negative_words from t")
def cardinal_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders", spread=True).select("o_orderkey", N.cardinal(F.col("o_orderkey")).alias("key_words"), N.cardinal(-F.col("o_custkey")).alias("negative_words"))


@query(f"with t as (select o_orderkey, day(o_orderdate) as d, o_orderkey as n from orders), w as (select *, {sql_cardinal('d')} as dw, {sql_cardinal('n')} as nw from t) select o_orderkey, {sql_ordinal('dw')} as day_words, {sql_ordinal('nw')} as key_words from w")
def ordinal_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders", spread=True).select("o_orderkey", N.ordinal(F.dayofmonth("o_orderdate")).alias("day_words"), N.ordinal(F.col("o_orderkey")).alias("key_words"))


@query(f"with t as (select o_orderkey, cast(year(o_orderdate) as bigint) as y, cast(1000 + o_orderkey % 1200 as bigint) as z from orders) select o_orderkey, {sql_year('y')} as year_words, {sql_year('z')} as other_words from t")
def year_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders", spread=True).select("o_orderkey", N.year(F.year("o_orderdate")).alias("year_words"), N.year(1000 + F.col("o_orderkey") % 1200).alias("other_words"))


_MONEY = f"""select {{keys}}, case when neg then 'negative ' else '' end || {sql_cardinal('d')} || case when d = 1 then ' dollar' else ' dollars' end
    || case when c > 0 then ' and ' || {sql_cardinal('c')} || case when c = 1 then ' cent' else ' cents' end else '' end as words from t"""


@query("with t as (select l_orderkey, l_linenumber, false as neg, cast(round(l_extendedprice * 100) as bigint) // 100 as d, cast(round(l_extendedprice * 100) as bigint) % 100 as c from lineitem) " + _MONEY.format(keys="l_orderkey, l_linenumber"))
def money_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    token = F.concat(F.lit("$"), (cents / 100).cast("long").cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    return table(spark, sf_dir, "lineitem", spread=True).select("l_orderkey", "l_linenumber", N.expand(token).alias("words"))


@query("with t as (select c_custkey, c_acctbal < 0 as neg, cast(round(abs(c_acctbal) * 100) as bigint) // 100 as d, cast(round(abs(c_acctbal) * 100) as bigint) % 100 as c from customer) " + _MONEY.format(keys="c_custkey"))
def balance_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.abs("c_acctbal") * 100).cast("long")
    token = F.concat(F.when(F.col("c_acctbal") < 0, "-").otherwise(""), F.lit("$"), (cents / 100).cast("long").cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    return table(spark, sf_dir, "customer").select("c_custkey", N.expand(token).alias("words"))


@query(f"with t as (select l_orderkey, l_linenumber, cast(round(l_discount * 1000) as bigint) as n from lineitem), u as (select *, n // 10 as d, n % 10 as f from t) select l_orderkey, l_linenumber, {sql_cardinal('d')} || ' point ' || {_ONES}[f + 1] || ' percent' as words from u")
def percent_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.round(F.col("l_discount") * 1000).cast("long")
    token = F.concat((n / 10).cast("long").cast("string"), F.lit("."), (n % 10).cast("string"), F.lit("%"))
    return table(spark, sf_dir, "lineitem", spread=True).select("l_orderkey", "l_linenumber", N.expand(token).alias("words"))


@query(
    f"""with t as (select p_partkey, p_partkey % 1000 as n, p_partkey % 4 as k from part), w as (select *, {sql_cardinal('n')} as c from t)
    select p_partkey, case k when 0 then c || ' k' when 1 then c || ' million euros' when 2 then {sql_ordinal('c')} else c || ' yen' end as words from w"""
)
def suffix_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = (F.col("p_partkey") % 1000).cast("string"), F.col("p_partkey") % 4
    token = F.when(k == 0, F.concat(n, F.lit("K"))).when(k == 1, F.concat(F.lit("€"), n, F.lit("M"))).when(k == 2, F.concat(n, F.lit("th"))).otherwise(F.concat(F.lit("¥"), n))
    return table(spark, sf_dir, "part").select("p_partkey", N.expand(token).alias("words"))


@query(f"with t as (select o_orderkey, cast(month(o_orderdate) as bigint) as m, cast(day(o_orderdate) as bigint) as d, cast(year(o_orderdate) as bigint) as y from orders), w as (select *, {sql_cardinal('d')} as dw from t) select o_orderkey, {_MONTHS}[m] || ' ' || {sql_ordinal('dw')} || ' ' || {sql_year('y')} as words from w")
def date_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders", spread=True).select("o_orderkey", N.date(F.month(d), F.dayofmonth(d), F.year(d)).alias("words"))


@query(f"with t as (select event_id, cast(hour(ts) as bigint) as h, cast(minute(ts) as bigint) as m from events) select event_id, {sql_cardinal('h')} || ' ' || case when m = 0 then 'o clock' when m < 10 then 'oh ' || {sql_two('m')} else {sql_two('m')} end || case when event_id % 2 = 0 then ' a m' else '' end as words from t")
def time_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", spread=True).select("event_id", N.clock(F.hour("ts"), F.minute("ts"), F.when(F.col("event_id") % 2 == 0, "A").otherwise("")).alias("words"))


@query(
    f"""with t as (select l_orderkey, l_linenumber, cast(l_linenumber as bigint) as a, cast(l_quantity as bigint) as b from lineitem), w as (select *, {sql_cardinal('a')} as aw, {sql_cardinal('b')} as bw from t),
    x as (select *, case b when 2 then 'half' when 4 then 'quarter' else regexp_extract({sql_ordinal('bw')}, '[a-z]+$', 0) end as part from w)
    select l_orderkey, l_linenumber, aw || ' ' || bw as ratio_words, aw || ' ' || case when a = 1 then part when part = 'half' then 'halves' else part || 's' end as fraction_words from x"""
)
def ratio_fraction_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("l_linenumber"), F.col("l_quantity").cast("long")
    return table(spark, sf_dir, "lineitem", spread=True).select("l_orderkey", "l_linenumber", N.ratio(a, b).alias("ratio_words"), N.fraction(a, b).alias("fraction_words"))


_ROMAN_TENS, _ROMAN_ONES = ["", "X", "XX", "XXX", "XL", "L"], ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]


@query("select p_partkey, p_size as value, p_size <= 10 as is_read from part")
def roman_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    numeral = F.concat(F.get(F.array(*map(F.lit, _ROMAN_TENS)), (n / 10).cast("int")), F.get(F.array(*map(F.lit, _ROMAN_ONES)), n % 10))
    value = N.roman_value(numeral)
    return table(spark, sf_dir, "part").select("p_partkey", value.alias("value"), (value <= 10).alias("is_read"))


# normalisation
def _collapse_sql(column: str, keep: int) -> str:
    for c in "abcdefghijklmnopqrstuvwxyzßàáâäçèéêëíîïñóôöùúûüœ":
        column = f"regexp_replace({column}, '{c}{{3,}}', '{c * keep}', 'g')"
    return column


@query(f"with t as (select c_custkey, lower(replace(c_mktsegment, 'E', repeat('E', cast(1 + c_custkey % 5 as integer)))) as w from customer) select c_custkey, array_to_string(list_distinct([{_collapse_sql('w', 1)}]) || case when {_collapse_sql('w', 1)} = {_collapse_sql('w', 2)} then [] else [{_collapse_sql('w', 2)}] end, ' ') as forms from t")
def elongation_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.lower(F.expr("replace(c_mktsegment, 'E', repeat('E', cast(1 + c_custkey % 5 as int)))"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(T.collapse_elongation(word), " ").alias("forms"))


@query("select doc_id, strip_accents(text) as folded, strip_accents(text) as folded_any from documents")
def diacritic_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks off Latin letters without leaving the JVM, and off letters of any script."""
    return table(spark, sf_dir, "documents", spread=True).select("doc_id", T.strip_marks(F.col("text")).alias("folded"), T.strip_marks_any(F.col("text")).alias("folded_any"))


@query("select conv_id, turn, replace(replace(text, ' ', chr(39) || ' one half  three quarters '), 'fi', 'fi') as folded from conversations")
def unicode_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with an apostrophe and two fractions for each space, full-width letters and ligatures all through."""
    marked = F.translate(F.replace(F.replace("text", F.lit(" "), F.lit("’½¾")), F.lit("fi"), F.lit("ﬁ")), "aeostBDR", "ａｅｏｓｔＢＤＲ")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.nfkc(T.expand_fractions(T.fold_apostrophes(marked))).alias("folded"))


@query("with w as (select unnest(string_split_regex(text, '[[:space:]]+')) as w from documents) select regexp_replace(lower(w), '[^a-z]', '', 'g') as az, count(*) as n from w group by 1")
def az_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents", spread=True).select(F.explode(F.split("text", r"\s+")).alias("w"))
    return words.groupBy(T.az_key(F.col("w")).alias("az")).agg(F.count("*").alias("n"))


@query(
    """with k as (select c_custkey, substr(regexp_replace(lower(c_name || c_mktsegment), '[^a-z]', '', 'g'), 1, 24) as k from customer)
    select c_custkey, array_to_string(list_transform(string_split(k, ''), lambda c: cast(ascii(c) - 96 as varchar)) || list_transform(range(24 - length(k)), lambda x: '0'), ',') as ids from k"""
)
def encode_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(T.encode_ids(F.concat("c_name", "c_mktsegment")), ",").alias("ids"))


@query("select c_custkey, lower(regexp_extract(c_mktsegment, '^([A-Z])', 1) || substr(c_mktsegment, 2)) || ' my ' || lower(c_mktsegment) || ' tag' as words from customer")
def handle_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(T.split_handle(F.concat(F.initcap(seg), F.lit("My_"), F.initcap(seg), F.lit("-Tag"))), " ").alias("words"))


_SET = lambda xs: "(" + ", ".join(f"'{x}'" for x in sorted(xs)) + ")"


@query(
    f"""with t as (select page_id, url, regexp_replace(url, '^https?://', '') as bare from pages), h as (select *, regexp_extract(bare, '^[^/?]*', 0) as host from t),
    l as (select *, string_split(lower(host), '.') as labels from h)
    select page_id, true as url_with_scheme, len(labels) >= 2 and (labels[-1] in {_SET(TLDS)} or (regexp_matches(bare, '[/?]') and regexp_matches(labels[-1], '^[a-z]{{2,}}$')) or (len(labels) >= 3 and length(labels[-1]) = 2 and labels[-2] in {_SET(REGISTRY_LABELS)})) as bare_is_url,
    contains(bare, '?') or regexp_matches(bare, '^[^/]*/.*[^/ ]') as bare_is_full from l"""
)
def url_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace("url", "^https?://", "")
    return table(spark, sf_dir, "pages").select("page_id", T.is_url(F.col("url")).alias("url_with_scheme"), T.is_url(bare).alias("bare_is_url"), T.is_full_url(bare).alias("bare_is_full"))


_SPELL = " ".join(f"when '{x}' then '{' '.join(x)}'" for x in sorted({"www"} | SPELLED_LABELS))


@query(
    f"""with h as (select page_id, string_split(lower(regexp_extract(url, '^https?://([^/?]*)', 1)), '.') as labels from pages)
    select page_id, array_to_string(list_transform(labels, lambda x: case x {_SPELL} else replace(x, '-', ' ') end), ' dot ') as words from h"""
)
def url_spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages", spread=True).select("page_id", F.array_join(T.read_host(F.lower("url")), " ").alias("words"))


@query(f"select s_suppkey, 'supplier dot ' || {sql_cardinal('n')} || ' at mail dot example dot c o' as words from (select s_suppkey, cast(s_suppkey % 1000 as bigint) as n from supplier)".replace("dot c o", "dot co"))
def email_spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    address = F.concat(F.lit("Supplier."), (F.col("s_suppkey") % 1000).cast("string"), F.lit("@mail.example.co"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(T.read_email(address), " ").alias("words"))


_GLYPHS = list(EMOJI)


@query(
    f"""with t as (select event_id, {[g for g in _GLYPHS]!r}[cast(event_id % {len(_GLYPHS)} + 1 as integer)] as g, {[n for n in EMOJI.values()]!r}[cast(event_id % {len(_GLYPHS)} + 1 as integer)] as name, event_type from events)
    select event_id, event_type || '|' || g || g || '|x' as runs, name || ', ' || name as names from t"""
)
def emoji_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    glyph = F.get(F.array(*map(F.lit, _GLYPHS)), (F.col("event_id") % len(_GLYPHS)).cast("int"))
    runs = T.emoji_runs(F.concat("event_type", glyph, glyph, F.lit("x")))
    names = T.emoji_names(F.element_at(F.filter(runs, lambda r: r["is_emoji"]), 1)["text"])
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(runs, lambda r: r["text"]), "|").alias("runs"), names.alias("names"))


# lines
def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, text) of all lines of all documents."""
    return table(spark, sf_dir, "documents", spread=True).where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations, each with a key of its own."""
    return table(spark, sf_dir, "conversations", spread=True).select(F.concat_ws("-", "conv_id", "turn").alias("line_id"), "text")


def _values(pairs) -> str:
    return ", ".join(f"('{w}', {'null' if n is None else n})" for w, n in pairs)


#: What each word that the tables know resolves to, first table first.
_TIERS = {w: (n, "cmudict") for w, n in SEED_LEXICON.items()}
_TIERS = {**{w: (n, "acronym") for w, n in ACRONYM.items()}, **_TIERS, **{w: (None, "abstain") for w in AMBIGUOUS}, **{w: (n, "initialism") for w, n in INITIALISM.items()}, **{w: (n, "slang") for w, n in SLANG.items()}}
_TIER_SQL = "tiers(word, n, source) as (values " + ", ".join(f"('{w}', {'null' if n is None else n}, '{s}')" for w, (n, s) in _TIERS.items()) + ")"
# words of conversations; marks between them are silent
_FORMS = ["f1", "f2", "strip_accents(f1)", "strip_accents(f2)"] + [f"regexp_replace({x}, '[^a-z]', '', 'g')" for x in ("f1", "f2", "strip_accents(f1)", "strip_accents(f2)")]
_SPELLED = "regexp_matches(form, '^\\p{L}{2,6}$') and not regexp_matches(form, '[aeiouy]')"
_WORDS_SQL = f"""with {_TIER_SQL}, lines as (select conv_id || '-' || turn as line_id, text from conversations),
    w as (select line_id, unnest(regexp_extract_all(text, '\\p{{L}}+')) as raw from lines),
    f as (select line_id, row_number() over () as id, raw, {_collapse_sql('lower(raw)', 1)} as f1, {_collapse_sql('lower(raw)', 2)} as f2 from w),
    c as (select id, unnest(range(1, 9)) as k, unnest([{', '.join(_FORMS)}]) as form from f),
    t as (select id, min(k) filter (source is not null) as hit, min(k) filter ({_SPELLED}) as spell from c left join tiers on word = form group by 1),
    h as (select f.line_id, f.raw, f.f1, x.source, x.n, case when regexp_matches(raw, '^\\p{{Lu}}{{2,6}}$') then lower(raw) else y.form end as letters, strip_accents(f1) as asked
        from f join t on t.id = f.id left join (c join tiers on word = form) x on x.id = f.id and x.k = t.hit left join c y on y.id = f.id and y.k = t.spell),
    k as (select line_id, raw, case when source is not null then source when letters is not null then 'letters' else 'abstain' end as source,
        case when source is not null then coalesce(n, 0) when letters is not null then length(letters) + 2 * (length(letters) - length(replace(letters, 'w', ''))) else 0 end as n, source is null and letters is null as oov, asked from h)"""


@query(_WORDS_SQL + " select source, cast(n as integer) as n, count(*) as tokens from k group by 1, 2")
def tier_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    traced = api.trace(turns(spark, sf_dir)).where("source not in ('punct', 'emoji', 'symbol')")
    return traced.groupBy("source", "n").agg(F.count("*").alias("tokens"))


@query(_WORDS_SQL + " select l.line_id, cast(coalesce(sum(n), 0) as integer) as total, cast(count(*) filter (k.source = 'abstain') as integer) as n_uncertain, count(*) filter (k.source = 'abstain') = 0 as confident from lines l left join k on k.line_id = l.line_id group by 1")
def line_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.analyze(turns(spark, sf_dir))


_HARD = "(length(raw) >= 16 or (length(raw) >= 7 and not regexp_matches(lower(raw), '[aeiou]')))"
_ROUTED = f", routed as (select l.line_id, l.text, coalesce(sum(n), 0) as det, count(*) filter (oov) as asked_n, coalesce(bool_or(k.source = 'abstain' and (not oov or {_HARD})), false) as hard, sum(case when oov then 1 + length(asked) % 3 else 0 end) as said from lines l left join k on k.line_id = l.line_id group by 1, 2)"


@query(_WORDS_SQL + _ROUTED + " select line_id, text, cast(case when not hard and asked_n = 0 then det end as integer) as syllable_count from routed")
def count_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.count_lines(turns(spark, sf_dir))


@query(_WORDS_SQL + _ROUTED + f", a as (select line_id, count(*) as n from k where oov and not {_HARD} group by 1) select r.line_id, case when hard then 'hard' when asked_n > 0 then 'det+oov' else 'det' end as routing, cast(det as integer) as det, cast(coalesce(n, 0) as integer) as asked from routed r left join a on a.line_id = r.line_id")
def line_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each line before any scorer."""
    routed = api.line_routes(turns(spark, sf_dir))
    return routed.select(F.col("line_key").alias("line_id"), policy.routing_label(F.col("oov_n"), F.col("hard")).alias("routing"), "det", F.col("oov_n").alias("asked"))


@query(_WORDS_SQL + _ROUTED + " select line_id, cast(case when not hard and asked_n = 0 then det end as integer) as syllable_count from routed")
def sql_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL function over single texts."""
    api.register(spark)
    return turns(spark, sf_dir).select("line_id", F.expr("syllable_count(text)").alias("syllable_count"))


@query(_WORDS_SQL + " select source, cast(n as integer) as n, count(*) as tokens from k group by 1, 2")
def sql_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL table function over single texts."""
    api.register(spark)
    traced = spark.sql("select t.* from {lines}, lateral syllable_trace(text) t", lines=turns(spark, sf_dir))
    return traced.where("source not in ('punct', 'emoji', 'symbol')").groupBy("source", "n").agg(F.count("*").alias("tokens"))


def asked_scorer(words: DataFrame) -> DataFrame:
    """All but sure of a count made of a word's length."""
    k = 1 + F.length("word") % 3
    return words.select("word", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda c: F.when(c == k, F.lit(0.993)).otherwise(F.lit(0.001))).alias("p"))


@query(_WORDS_SQL + _ROUTED + " select line_id, text, cast(case when not hard then det + said end as integer) as syllable_count from routed")
def oov_table_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.count_lines(turns(spark, sf_dir), scorer=asked_scorer)


@query(_WORDS_SQL + _ROUTED + ", b(most) as (values (20), (60), (120)) select line_id, most, cast(case when not hard and det + asked_n <= most and det + said <= most then det + said end as integer) as syllable_count from routed cross join b")
def budget_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, budgets = turns(spark, sf_dir), (20, 60, 120)
    each = lines.select("line_id", F.explode(F.array(*map(F.lit, budgets))).alias("most"))
    return each.join(api.count_keys(lines, scorer=asked_scorer, most=budgets), ["line_id", "most"], "left")


@query()
def haiku_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: which lines of all documents surely count 5 or 7."""
    lines = document_lines(spark, sf_dir).select(F.struct("doc_id", "line_no").alias("line_id"), "text")
    return api.haiku_keys(lines).select("line_id.doc_id", "line_id.line_no", "syllable_count")


@query()
def document_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = document_lines(spark, sf_dir).select(F.concat_ws("-", "doc_id", "line_no").alias("line_id"), "text")
    return api.analyze(lines)


@query("with w as (select unnest(regexp_extract_all(text, '\\p{L}+|[^\\s\\p{L}]')) as t from conversations) select case when regexp_matches(t, '^\\p{L}') then 'word' else 'punct' end as kind, count(*) as n from w group by 1")
def token_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = tokens.explode_tokens(tokens.tokenize(turns(spark, sf_dir), frozenset()).drop("text"))
    return scanned.groupBy("kind").agg(F.count("*").alias("n"))


# a special token after a word, of a kind that each event has in turn: what it is and what it says
_SPECIAL = f"""with e as (select event_id, cast(event_id % 12 as integer) as k, cast(user_id % 1000 as bigint) as n, cast(1 + event_id % 28 as bigint) as d, cast(1 + event_id % 11 as bigint) as m from events),
    w as (select *, {sql_cardinal('n')} as nw, {sql_cardinal('d')} as dw, {sql_cardinal('m')} as mw, {sql_cardinal('(n % 100)')} as aw from e),
    special as (select event_id, k, case k when 0 then '$' || n || '.50' when 1 then 'user.' || n || '@mail.example.com' when 2 then '@user_' || n when 3 then '#' || n when 4 then '#GreatBigDay' || d when 5 then ':)' when 6 then 'w/o' when 7 then '&'
        when 8 then m || '/' || d || '/2026' when 9 then m || ':30pm' when 10 then (n % 100) || '-' || d else 'www.example.com/' || n end as raw,
    case k when 0 then 'number' when 1 then 'url' when 5 then 'emoji' when 7 then 'symbol' when 8 then 'date' when 9 then 'time' when 10 then 'ratio' when 11 then 'url' else 'word' end as kind,
    case k when 0 then nw || case when n = 1 then ' dollar' else ' dollars' end || ' and fifty cents' when 1 then 'user dot ' || nw || ' at mail dot example dot com' when 2 then 'at user ' || nw when 3 then 'number ' || nw when 4 then 'great big day ' || dw
        when 6 then 'without' when 7 then 'and' when 8 then {_MONTHS}[m] || ' ' || {sql_ordinal('dw')} || ' twenty twenty six' when 9 then mw || ' thirty p m' when 10 then aw || ' ' || dw when 11 then 'w w w dot example dot com' end as words,
    case k when 0 then 'number' when 1 then 'spoken url' when 2 then 'mention' when 3 then 'number sign' when 4 then 'hashtag' when 5 then 'emoticon' when 6 then 'shorthand' when 7 then 'symbol' when 8 then 'date' when 9 then 'time' when 10 then 'ratio' else 'spoken url' end as note from w)"""


def special_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, text): the lines that _SPECIAL has in SQL."""
    e = table(spark, sf_dir, "events", spread=True).select("event_id", (F.col("event_id") % 12).alias("k"), (F.col("user_id") % 1000).alias("n"), (1 + F.col("event_id") % 28).alias("d"), (1 + F.col("event_id") % 11).alias("m"))
    forms = ["concat('$', n, '.50')", "concat('user.', n, '@mail.example.com')", "concat('@user_', n)", "concat('#', n)", "concat('#GreatBigDay', d)", "':)'", "'w/o'", "'&'", "concat(m, '/', d, '/2026')", "concat(m, ':30pm')", "concat(n % 100, '-', d)", "concat('www.example.com/', n)"]
    return e.select("event_id", F.expr("concat('cat ', case k " + " ".join(f"when {k} then {f}" for k, f in enumerate(forms)) + " end)").alias("text"))


@query(_SPECIAL + " select event_id, 0 as pos, 'cat' as raw, 'word' as kind, null as words, '' as note from special union all select event_id, 1, raw, kind, words, note from special")
def special_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scanner reads: amounts, addresses, links, mentions, number signs, hashtags, faces, short forms, symbols, dates, times and ratios."""
    scanned = tokens.explode_tokens(tokens.tokenize(special_lines(spark, sf_dir), frozenset()).drop("text"))
    return scanned.select("event_id", "pos", "raw", "kind", F.when(F.size("words") > 0, F.array_join("words", " ")).alias("words"), "note")


_LEXICON_SQL = "lexicon(word, n) as (values " + ", ".join(f"('{w}', {n})" for w, n in SEED_LEXICON.items()) + ")"
_SAID_SQL = _SPECIAL + f""", {_LEXICON_SQL}, {_TIER_SQL}, said as (select event_id, unnest(string_split(words, ' ')) as word from special where words is not null),
    c as (select event_id, coalesce(l.n, t.n, case when regexp_matches(s.word, '^[a-z]{{2,6}}$') and not regexp_matches(s.word, '[aeiouy]') then length(s.word) + 2 * (length(s.word) - length(replace(s.word, 'w', ''))) end) as n from said s left join lexicon l on l.word = s.word left join tiers t on t.word = s.word),
    sums as (select event_id, coalesce(sum(n), 0) as n, count(*) filter (n is null) as lost from c group by 1)"""


@query(_SAID_SQL + " select s.event_id, cast(1 + coalesce(n, 0) as integer) as total, coalesce(lost, 0) > 0 as unsure from special s left join sums on sums.event_id = s.event_id")
def special_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of lines with special tokens, by the words that these say."""
    sums = api.analyze(special_lines(spark, sf_dir), key="event_id")
    return sums.select("event_id", "total", (~F.col("confident")).alias("unsure"))


@query(_SAID_SQL + " select s.event_id, cast(1 + coalesce(n, 0) as integer) as syllable_count from special s left join sums on sums.event_id = s.event_id where coalesce(lost, 0) = 0 and k <> 11")
def special_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sure counts of the same lines: a link with a path is given up."""
    return api.count_keys(special_lines(spark, sf_dir), key="event_id")


@query("with w as (select distinct lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) as w from conversations) select w as word, length(w) between 2 and 6 and not regexp_matches(w, '[aeiouy]') as spelled, cast(length(w) + 2 * (length(w) - length(replace(w, 'w', ''))) as integer) as letters from w")
def letter_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "conversations", spread=True).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).select(F.lower("w").alias("word")).distinct()
    return words.select("word", resolve.spelled(F.col("word")).alias("spelled"), T.letters_count(F.col("word")).alias("letters"))


@query(
    """with w as (select distinct unnest(regexp_extract_all(text, '[A-Za-z]+')) as w from documents), s as (select w, string_split(substr(w, 2), '') as c from w),
    f as (select w, len(list_filter(range(1, greatest(len(c), 1)), lambda i: (c[i] = upper(c[i])) <> (c[i + 1] = upper(c[i + 1])))) as flips from s)
    select w as word, length(w) >= 16 or flips >= 4 or (length(w) >= 7 and not regexp_matches(lower(w), '[aeiou]')) as junk from f"""
)
def junk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents", spread=True).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", T.looks_junk(F.col("word")).alias("junk"))


# scores
_SOFTMAX = "e as (select vec_id, label, list_transform(range(1, 9), lambda i: exp(6 * cast(embedding[i] as double) + case when i = 1 + label % 8 then 2 else 0 end)) as e from embeddings), s as (select vec_id, label, list_transform(e, lambda x: x / list_sum(e)) as p from e)"


def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, p): class probabilities made of the first eight dimensions, leaning to one made of the label."""
    e = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.exp(6 * F.element_at("embedding", i).cast("double") + F.when(i == 1 + F.col("label") % 8, 2).otherwise(0)))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", e.alias("e"))
    return rows.select("vec_id", "label", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda s, y: s + y)).alias("p"))


def _gate_sql(f: str) -> str:
    return f"case when m >= (1 - {f}) * 0.85 and m - second >= (1 - {f}) * 0.35 then cast(list_position(p, m) as integer) end"


_RANKED = f"with {_SOFTMAX}, r as (select *, list_max(p) as m, list_sort(p)[7] as second from s)"


@query(_RANKED + f" select vec_id, {_gate_sql('0.0')} as strict, {_gate_sql('0.5')} as half, {_gate_sql('1.0')} as loose, case when {_gate_sql('0.0')} is not null then 0.0 when {_gate_sql('0.25')} is not null then 0.25 when {_gate_sql('0.5')} is not null then 0.5 when {_gate_sql('0.75')} is not null then 0.75 else 1.0 end::double as least from r")
def gate_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p")
    return softmax(spark, sf_dir).select("vec_id", policy.gate(p, 0.0).alias("strict"), policy.gate(p, 0.5).alias("half"), policy.gate(p, 1.0).alias("loose"), policy.lowest_fuzziness(p).alias("least"))


@query(_RANKED + f", f(fuzziness) as (values (0.0::double), (0.25), (0.5), (0.75), (1.0)) select fuzziness, count({_gate_sql('fuzziness')}) as accepted, count(*) as n from r cross join f group by 1")
def fuzziness_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = spark.createDataFrame([(f,) for f in policy.STEPS], "fuzziness double")
    rows = softmax(spark, sf_dir).crossJoin(F.broadcast(steps))
    return rows.groupBy("fuzziness").agg(F.count(policy.gate(F.col("p"), F.col("fuzziness"))).alias("accepted"), F.count("*").alias("n"))


_SCORED = f"with {_SOFTMAX}, y as (select *, cast(1 + label % 8 as integer) as y, label % 3 = 0 as ambiguous from s), z as (select *, case when ambiguous then list_distinct([y, y % 8 + 1]) else [y] end as valid, list_position(p, list_max(p)) as pred from y)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = (1 + F.col("label") % 8).cast("int")
    rows = softmax(spark, sf_dir).withColumn("y", y).withColumn("ambiguous", F.col("label") % 3 == 0)
    return rows.withColumn("valid", F.when(F.col("ambiguous"), F.array_distinct(F.array("y", F.col("y") % 8 + 1))).otherwise(F.array("y")))


@query(
    _SCORED + """, o as (select vec_id, unnest(range(1, 9)) as c, p, valid from z where ambiguous), q as (select vec_id, c, p[c] as x, list_contains(valid, cast(c as integer)) as v from o),
    w as (select *, coalesce(sum(x) over (partition by vec_id order by x desc, c rows between unbounded preceding and 1 preceding), 0) as before from q),
    a as (select vec_id, bool_and(not v or before < 0.9) as covered, sum(case when v then x else 0 end) as m from w group by 1)
    select avg(case when pred = y then 1.0 else 0 end) as exact, avg(case when abs(pred - y) <= 1 then 1.0 else 0 end) as within1, avg(cast(abs(pred - y) as double)) as mae, avg(case when list_contains(valid, cast(pred as integer)) then 1.0 else 0 end) as lenient,
    (select avg(case when covered then 1.0 else 0 end) from a) as amb_cover, (select round(avg(m), 9) from a) as amb_mass, count(*) filter (ambiguous) as amb_n, avg(case when y >= 4 then case when pred = y then 1.0 else 0 end end) as tail from z"""
)
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.metrics(scored(spark, sf_dir)).withColumn("amb_mass", F.round("amb_mass", 9))


@query(_SCORED + " select y, count(*) as n, round(avg(case when pred = y then 1.0 else 0 end), 3) as exact from z group by 1")
def per_count_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.per_count(scored(spark, sf_dir))


@query(_SCORED + ", c as (select y, round(avg(case when pred = y then 1.0 else 0 end), 3) as exact, count(*) as n from z group by 1) select round(avg(exact), 9) as exact_mean, round(stddev_pop(exact), 9) as exact_std, round(avg(n), 9) as n_mean, round(stddev_pop(n), 9) as n_std from c")
def measure_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = evaluate.spread(evaluate.per_count(scored(spark, sf_dir)), ["exact", "n"])
    return spread.select(*(F.round(c, 9).alias(c) for c in spread.columns))


@query(_SCORED + ", t as (select vec_id, unnest(range(1, 9)) as count, p from z), r as (select vec_id, count, row_number() over (partition by vec_id order by p[count] desc, count) as rank from t) select vec_id, cast(rank as integer) as rank, cast(count as integer) as count from r where rank <= 3")
def top_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = softmax(spark, sf_dir).select("vec_id", F.posexplode(evaluate.top_classes(F.col("p"))).alias("k", "top"))
    return top.select("vec_id", (F.col("k") + 1).alias("rank"), "top.count")


@query(f"with {_SOFTMAX}, u as (select label, unnest(range(1, 9)) as k, p from s), m as (select label, k, avg(p[k]) as x from u group by 1, 2) select label, cast(k as integer) as k, round(x, 9) as p from m")
def ensemble_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = evaluate.ensemble(softmax(spark, sf_dir), ["label"])
    return mean.select("label", F.posexplode("p").alias("k", "x")).select("label", (F.col("k") + 1).alias("k"), F.round("x", 9).alias("p"))


# lexicon
# sources made of a table: part names and types as words, their letters as phones
_PARTS = "select p_partkey as line_no, lower(regexp_replace(p_type, '[^A-Za-z]', '', 'g')) || chr(cast(97 + p_partkey % 7 as integer)) as w, p_partkey % 5 as k from part"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.concat(F.lower(F.regexp_replace("p_type", "[^A-Za-z]", "")), F.chr(97 + F.col("p_partkey") % 7))
    return table(spark, sf_dir, "part", spread=True).select(F.col("p_partkey").alias("line_no"), w.alias("w"), (F.col("p_partkey") % 5).alias("k"))


def cmu_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    head = F.concat("w", F.when(k == 0, "(2)").otherwise(""))
    phones = F.array_join(F.array_repeat(F.lit("B AH1"), k.cast("int") + 1), " ")
    return _parts(spark, sf_dir).select("line_no", F.concat(head, F.lit(" "), phones, F.when(k == 3, " K # note 1").otherwise("")).alias("value"))


_CMU = f"cmu as (select w as word, coalesce(min_by(n, line_no) filter (not variant), min(n)) as primary_, list_sort(list_distinct(list(n))) as counts from (select line_no, w, k + 1 as n, k = 0 as variant from ({_PARTS})) group by 1)"


@query(f"with {_CMU} select word, cast(primary_ as integer) as primary, array_to_string(counts, ',') as counts from cmu")
def cmudict_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.parse_cmudict(cmu_lines(spark, sf_dir)).select("word", "primary", F.array_join("counts", ",").alias("counts"))


def wiki_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir).where("k >= 2")
    phones = F.array_join(F.array_repeat(F.lit("b ə i t"), F.col("k").cast("int") - 1), " ")
    return rows.select("line_no", F.concat(F.initcap("w"), F.when(F.col("k") == 4, "x").otherwise(""), F.lit("\t"), phones).alias("value"))


_WIKI = f"wiki as (select w || case when k = 4 then 'x' else '' end as word, list_sort(list_distinct(list(k - 1))) as counts from ({_PARTS}) where k >= 2 group by 1)"


@query(f"with {_WIKI} select word, array_to_string(counts, ',') as counts from wiki")
def wikipron_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.parse_wikipron(wiki_lines(spark, sf_dir)).select("word", F.array_join("counts", ",").alias("counts"))


def kaikki_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    hyph = F.when(k == 1, "").otherwise(F.concat((k + 1).cast("string"), F.lit(","), (k + 2).cast("string")))
    return _parts(spark, sf_dir).where("k <= 3").select("line_no", F.concat("w", F.when(k == 2, "z").otherwise(""), F.lit("\t"), k.cast("string"), F.lit("\t"), hyph).alias("value"))


_KAIKKI = f"kaikki as (select w || case when k = 2 then 'z' else '' end as word, max_by(k, line_no) as k from ({_PARTS}) where k <= 3 group by 1), hyph as (select word, [k + 1, k + 2] as counts from kaikki where k <> 1)"


@query(f"with {_KAIKKI} select word, cast(k as varchar) as ipa, case when k = 1 then '' else (k + 1) || ',' || (k + 2) end as hyph from kaikki")
def kaikki_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.parse_kaikki(kaikki_lines(spark, sf_dir)).select("word", F.array_join("ipa", ",").alias("ipa"), F.array_join("hyph", ",").alias("hyph"))


_MERGED = f"""{_CMU}, {_WIKI}, {_KAIKKI}, j as (select coalesce(c.word, w.word, h.word) as word, c.primary_ as cp, c.counts as c, w.counts as w, h.counts as h from cmu c full join wiki w on c.word = w.word full join hyph h on coalesce(c.word, w.word) = h.word),
    lexicon as (select word, coalesce(cp, list_min(h), list_min(w)) as n, case when c is not null and h is not null then list_sort(list_distinct(c || h)) else coalesce(c, h, w) end as valid,
    coalesce(len(c) > 1, false) or coalesce(len(h) > 1, false) or coalesce(c <> h, false) as ambiguous, case when c is not null then 'cmu' when h is not null then 'kaikki' else 'wikipron' end as source from j)"""


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.reconcile(lexicon.parse_cmudict(cmu_lines(spark, sf_dir)), lexicon.parse_wikipron(wiki_lines(spark, sf_dir)), lexicon.parse_kaikki(kaikki_lines(spark, sf_dir)))


@query(f"with {_MERGED} select word, cast(n as integer) as primary, array_to_string(valid, ',') as valid, ambiguous, source from lexicon")
def reconcile_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir).select("word", "primary", F.array_join("valid", ",").alias("valid"), "ambiguous", "source")


@query(f"with {_MERGED}, v as (select word, list_filter(valid, lambda c: c between 1 and 8) as valid, n from lexicon where n between 1 and 8) select word, array_to_string(list_transform(range(1, 9), lambda c: case when list_contains(valid, c) then cast(round(1.0 / len(valid), 3) as varchar) else '0' end), ',') as labels from v".replace("cast(round(1.0 / len(valid), 3) as varchar)", "case len(valid) when 1 then '1' when 2 then '1/2' when 3 then '1/3' else '1/' || len(valid) end"))
def soft_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = lexicon.soft_labels(F.col("valid"))
    said = F.transform(labels, lambda x: F.when(x == 0, "0").when(x == 1, "1").otherwise(F.concat(F.lit("1/"), F.round(1 / x).cast("int").cast("string"))))
    return lexicon.in_range(merged(spark, sf_dir)).select("word", F.array_join(said, ",").alias("labels"))


def _stem_sql(w: str) -> str:
    return "case " + " ".join(f"when {w} like '%{s}' and length({w}) >= {len(s) + 3} then substr({w}, 1, length({w}) - {len(s)})" for s in lexicon.SUFFIXES) + f" else {w} end"


@query(f"with w as (select distinct lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) as w from documents) select {_stem_sql('w')} as stem, count(*) as words from w group by 1")
def stem_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents", spread=True).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).select(F.lower("w").alias("w")).distinct()
    return words.groupBy(lexicon.stem(F.col("w")).alias("stem")).agg(F.count("*").alias("words"))


@query()
def split_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.split(lexicon.in_range(merged(spark, sf_dir)), "hard").select("word", "source", "part")


@query(
    f"""with {_MERGED}, seed(word, n) as (values {_values(SEED_LEXICON.items())}), w as (select distinct lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) as word from conversations), known as (select word from seed union select word from lexicon),
    p as (select w.word, k.word as corrected, damerau_levenshtein(w.word, k.word) as distance from w join known k on w.word <> k.word and length(w.word) >= 4 and abs(length(w.word) - length(k.word)) <= 2
        and (substr(w.word, 1, 1) = substr(k.word, 1, 1) or substr(k.word, 1, 2) = reverse(substr(w.word, 1, 2)))),
    n as (select *, min(distance) over (partition by word) as least from p where distance <= case when length(word) >= 8 then 2 else 1 end)
    select word, min(corrected) as corrected, cast(min(distance) as integer) as distance from n where distance = least group by word having count(*) = 1"""
)
def spellfix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of conversations held against the reconciled lexicon and the seed."""
    words = table(spark, sf_dir, "conversations", spread=True).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word"))
    return resolve.correct(words, resolve.seed_lexicon(spark).select("word").unionByName(merged(spark, sf_dir).select("word")))


@query()
def npz_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The network with random weights over the distinct words of conversations."""
    words = table(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("word")).distinct()
    scored = scorer.model_scorer(scorer.random_weights(seed=5))(words)
    return scored.select("word", F.transform("p", lambda x: F.round(x, 6)).alias("p"))


# streaming
def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as commits of posts."""
    k = F.col("event_id") % 7
    langs = F.when(k == 0, F.array(F.lit("fr"))).when(k == 1, F.array(F.lit("fr"), F.lit("en-GB"))).otherwise(F.array(F.lit("en")))
    text = F.when(k == 2, "  ").when(F.col("event_id") % 2 == 0, " five cats in the house ").otherwise("nine dogs go to the town and the top")
    record = F.struct(F.when(k == 3, "like").otherwise(posts.POST_TYPE).alias("type"), text.alias("text"), langs.alias("langs"), F.when(k == 4, "x").alias("reply"))
    return table(spark, sf_dir, "events", spread=True).select(F.when(F.col("event_type") == "click", "delete").otherwise("create").alias("action"), F.concat(F.lit(posts.POST_TYPE), F.lit("/"), "event_id").alias("path"), record.alias("record"))


@query("select count(*) as seen, count(*) filter (event_id % 2 = 0) as haiku_hits from events where event_type <> 'click' and event_id % 7 in (1, 5, 6)")
def post_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filters and counters of the stream over a whole table."""
    kept = posts.english_posts(posts.created(commits(spark, sf_dir)))
    return posts.counters(kept.withColumn("syllable_count", posts.sure_count(F.col("text"), SEED_LEXICON, 7)))
