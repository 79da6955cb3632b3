"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import conversation_repair, decontamination, language_model, line_dedup, minhash, mixing, pii, quality_classifier, quality_rules, suffix_dedup, token_alignment, toxicity, url_filter


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(_table(spark, folder, "pages"))


def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(_table(spark, folder, "documents"))


def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.report(_table(spark, folder, "documents"))


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.dedup(_table(spark, folder, "documents"))


def op7_dart_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, folder, "documents"))


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(_table(spark, folder, "documents"))


def op8_subword_lattice(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.score(_table(spark, folder, "documents"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return token_alignment.align(_table(spark, folder, "documents"))


def op12_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.digest(_table(spark, folder, "documents"))


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_repair.report(_table(spark, folder, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_pii": op2_pii,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_mixing": op4_mixing,
    "op5_quality_rules": op5_quality_rules,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_dart_minhash": op7_dart_minhash,
    "op8_subword_lattice": op8_subword_lattice,
    "op9_toxicity": op9_toxicity,
    "op10_decontamination": op10_decontamination,
    "op11_token_alignment": op11_token_alignment,
    "op12_line_dedup": op12_line_dedup,
    "op13_conversation_repair": op13_conversation_repair,
}

LINE_DEDUP_SQL = """
with whole as (
  select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents
), lines as (
  select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos from whole
), keyed as (
  select doc_id, line, pos, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as line_key
  from lines
), shared as (
  select line_key, min(doc_id) as head from keyed where length(line_key) >= 10
  group by line_key having count(distinct doc_id) > 1
), marked as (
  select k.doc_id, k.line, k.pos, coalesce(k.doc_id <> s.head, false) as gone
  from keyed k left join shared s on k.line_key = s.line_key
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id"""



def _repair_moves() -> tuple[str, str]:
    """VALUES rows (s, op, need, t, cost, letters, pre, who): up to three inserts, then an edit; and the ends of a walk."""
    after, roles = {0: 2, 1: 2, 2: 3, 3: 2}, {2: "user", 3: "assistant"}
    moves, ends = [], []
    for s in range(4):
        at, pre = s, ""
        for k in range(4):
            ahead, cost = "I" * k, 5 * k
            moves.append((s, "D", "", at, cost + 2, ahead + "D", pre, ""))
            moves.append((s, "R", "", after[at], cost + 1, ahead + "R", pre, roles[after[at]]))
            for need, begin, end in (("s", 0, 1), ("u", 0, 2), ("u", 1, 2), ("u", 3, 2), ("a", 2, 3)):
                if begin == at:
                    moves.append((s, "K", need, end, cost, ahead + "K", pre, ""))
            if at in (0, 3):
                ends.append((s, cost, ahead, pre))
            at = after[at]
            pre += f"\n{roles[at]}:"
    rows = [", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in found) for found in (moves, ends)]
    return rows[0], rows[1]


_MOVES, _ENDS = _repair_moves()
_CRC_TABLE = "select n, n as c from (select unnest(range(256)) as n)"
for _ in range(8):
    _CRC_TABLE = f"select n, xor(c >> 1, 3988292384 * (c & 1)) as c from ({_CRC_TABLE})"

CONVERSATION_REPAIR_SQL = f"""
with recursive tab as (select list(c order by n) as t from ({_CRC_TABLE})),
named as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    concat(coalesce(conv_id::varchar, ' '), ':', coalesce(turn::varchar, ' ')) as name from conversations
), coded as (
  select conv_id, turn, role, text, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(string_split(name, ''), lambda x: ascii(x)::bigint)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 as code
  from named cross join tab
), damaged as (
  select conv_id, turn, case code when 4 then 'user' else role end as role,
    case code when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from coded where code <> 0
  union all select conv_id, turn, role, text from coded where code = 3
), ordered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i,
    trim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) as bare from damaged
), faults as materialized (
  select conv_id, turn, role, text, i,
    case when bare = '' then 1
      when row_number() over (partition by conv_id, role, text order by i) > 1 then 2
      when right(bare, 1) not in ('.', '!', '?') then 3 else 0 end as fault,
    coalesce(concat(lag(left(role, 1)) over (partition by conv_id order by i), left(role, 1))
      not in ('su', 'ua', 'au') and i > 1, false) as illegal
  from ordered
), moves(s, op, need, t, cost, letters, pre, who) as (values {_MOVES}),
ends(s, cost, letters, pre) as (values {_ENDS}),
walk(conv_id, i, s, best) as (
  select distinct conv_id, 0::bigint, 0, {{'c': 0::bigint, 'a': '', 'r': ''}} from conversations
  union all
  select w.conv_id, w.i + 1, m.t, min({{
    'c': w.best.c + m.cost + case when f.fault = 3 and m.op <> 'D' then 5 else 0 end,
    'a': w.best.a || m.letters,
    'r': w.best.r || m.pre || case m.op when 'K' then chr(10) || f.role || ':' || f.text
      when 'R' then chr(10) || m.who || ':' || f.text else '' end}})
  from walk w join faults f on f.conv_id is not distinct from w.conv_id and f.i = w.i + 1
  join moves m on m.s = w.s and (m.op = 'D' or f.fault not in (1, 2)) and (m.op <> 'K' or m.need = left(f.role, 1))
  group by w.conv_id, w.i, m.t
), counts as (
  select c.conv_id, coalesce(max(f.i), 0) as n,
    coalesce(max(f.turn) - min(f.turn) + 1 - count(distinct f.turn), 0) as gaps,
    count(*) filter (where f.fault = 1) as blank, count(*) filter (where f.fault = 2) as duplicate,
    count(*) filter (where f.fault = 3) as truncated, count(*) filter (where f.illegal) as illegal
  from (select distinct conv_id from conversations) c left join faults f on f.conv_id is not distinct from c.conv_id
  group by c.conv_id
), solved as (
  select w.conv_id, min({{'c': w.best.c + e.cost, 'a': w.best.a || e.letters, 'r': w.best.r || e.pre}}) as best
  from walk w join counts c on c.conv_id is not distinct from w.conv_id and c.n = w.i join ends e on e.s = w.s
  group by w.conv_id
)
select c.conv_id, gaps, blank, duplicate, truncated, illegal, best.c as cost, best.a as audit, sha256(best.r[2:]) as repaired_sha256
from counts c join solved s on s.conv_id is not distinct from c.conv_id"""

ORACLES: dict[str, str] = {"op12_line_dedup": LINE_DEDUP_SQL, "op13_conversation_repair": CONVERSATION_REPAIR_SQL}
