"""The operators of this subpackage as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cadence.llm import decontam, linededup, lm, minhash, packing, substrings, tokenframes, topk, toxicity, urltree


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.url_templates(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.repeated_lines(table(spark, sf_dir, "documents"), min_words=1)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_spans(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenframes.encode(table(spark, sf_dir, "documents"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


#: All queries by all rows, by cosine, rounded and ranked as the operator does; a brute-force join, for small tables.
TOPK_SQL = f"""with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
u as (select vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as e from v),
p as (select a.vec_id, b.vec_id as neighbor_id, round(list_dot_product(a.e, b.e), {topk.PLACES}) as score from u a join u b on a.vec_id <> b.vec_id where a.vec_id % {topk.EVERY} = 0),
r as (select *, row_number() over (partition by vec_id order by score desc, neighbor_id) as rank from p)
select vec_id, cast(rank as integer) as rank, neighbor_id, score from r where rank <= {topk.K}"""

_WORDS = r"regexp_extract_all(lower(text), '(?:[a-z0-9]|[^\x00-\x7F])+')"

#: All pairs that share a gram, and what they connect: candidates that MinHash misses would show, on tables small enough for the join.
MINHASH_SQL = f"""with recursive d as (select doc_id, {_WORDS} as w from documents where doc_id is not null and text is not null),
g as (select distinct doc_id, unnest(case when len(w) < {minhash.SHINGLE} then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - {minhash.SHINGLE - 2}), lambda i: array_to_string(w[i:i + {minhash.SHINGLE - 1}], ' ')) end) as gram from d),
n as (select doc_id, count(*) as n from g group by 1),
e as (select a.doc_id as a, b.doc_id as b from g a join g b on a.gram = b.gram and a.doc_id <> b.doc_id join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id group by 1, 2, x.n, y.n having count(*) >= {minhash.THRESHOLD}e0 * (x.n + y.n - count(*))),
c(id, root) as (select distinct a, a from e union select e.b, c.root from c join e on e.a = c.id)
select id as doc_id, min(root) as kept_id from c group by 1 having min(root) < id"""

#: Windows by their words; each that isn't the first of its kind goes, and those that touch are one span.
SPANS_SQL = f"""with d as (select doc_id, {_WORDS} as w from documents where doc_id is not null and text is not null),
p as (select doc_id, w, unnest(range(1, len(w) - {substrings.LEAST - 2})) as s from d where len(w) >= {substrings.LEAST}),
x as (select doc_id, s - 1 as s, row_number() over (partition by array_to_string(w[s:s + {substrings.LEAST - 1}], ' ') order by doc_id, s) as k from p),
r as (select doc_id, s, case when s <= max(s + {substrings.LEAST}) over (partition by doc_id order by s rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from x where k > 1),
t as (select *, sum(new) over (partition by doc_id order by s) as run from r)
select doc_id, cast(min(s) as integer) as start_word, cast(max(s) + {substrings.LEAST} as integer) as end_word from t group by doc_id, run"""

_LETTERS = "etaonirsldu "
_EDITS = f"floor({1 - linededup.THRESHOLD:.9g}e0 * b.size + 1e-9)"

#: All pairs of lines of about a length whose frequent letters don't tell them apart, by edit distance. As that goes by bytes here, the letters of the tables that have more than one get others.
LINES_SQL = f"""with recursive l as (select doc_id, unnest(range(len(string_split(text, chr(10))))) as line_no, string_split(text, chr(10)) as lines from documents where doc_id is not null and text is not null),
n as (select doc_id, line_no, trim(regexp_replace(lower(lines[line_no + 1]), '[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+', ' ', 'g')) as norm from l),
m as (select doc_id, line_no, translate(norm, 'éóèñçüêäößí', 'ABCDEFGHIJK') as t, length(norm) as size from n where norm <> ''),
s as (select t, size, row_number() over (order by t) as id, {', '.join(f"size - length(replace(t, '{c}', '')) as n{k}" for k, c in enumerate(_LETTERS))} from (select distinct t, size from m)),
e as (select a.id as a, b.id as b from s a join s b on a.id <> b.id and b.size between a.size and cast(a.size / {linededup.THRESHOLD} as bigint) + 1 and (a.size < b.size or a.id < b.id) where b.size - a.size <= {_EDITS}
    and {' + '.join(f'abs(a.n{k} - b.n{k})' for k in range(len(_LETTERS)))} <= 2 * {_EDITS} and levenshtein(a.t, b.t) <= {_EDITS}),
g as (select a, b from e union all select b, a from e),
c(id, root) as (select distinct a, a from g union select g.b, c.root from c join g on g.a = c.id),
r as (select id, min(root) as root from c group by 1),
k as (select m.doc_id, m.line_no, coalesce(r.root, s.id) as root from m join s on m.t = s.t left join r on r.id = s.id),
f as (select *, min(struct_pack(doc_id := doc_id, line_no := line_no)) over (partition by root) as kept from k)
select doc_id, cast(line_no as integer) as line_no, kept.doc_id as kept_doc_id, cast(kept.line_no as integer) as kept_line_no from f where doc_id <> kept.doc_id or line_no <> kept.line_no"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_url_templates": op2_url_templates,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_line_dedup": op4_line_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_token_frames": op8_token_frames,
    "op9_lm_scores": op9_lm_scores,
    "op10_exact_topk": op10_exact_topk,
}
ORACLE_SQL: dict[str, str] = {
    "op1_minhash_dedup": MINHASH_SQL,
    "op2_url_templates": urltree.oracle_sql(),
    "op4_line_dedup": LINES_SQL,
    "op6_substring_dedup": SPANS_SQL,
    "op10_exact_topk": TOPK_SQL,
}
