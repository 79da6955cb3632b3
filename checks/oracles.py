"""The registered queries as DuckDB SQL over the same tables.

Written apart from the Spark code: recursion where Spark walks level by level,
plain joins where Spark numbers blocks, chained replacements where Spark loops.
"""

from __future__ import annotations

from checks import fixtures as D
from checks.queries import MERGES, PACK_MERGES, WEIGHTS
from threadloom import fixed_values as V

WORD = r"[\p{L}\p{N}_]"
TOKEN = rf"<{WORD}+>"
ORACLES: dict[str, str] = {}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def messages(template: str, offset: str = "") -> str:
    return f"msgs as ({D.on_duckdb(template, offset)})"


def english(t: str) -> str:
    letters = f"length(regexp_replace({t}, '[^A-Za-z]', '', 'g'))"
    return f"coalesce({letters} / nullif(length({t}), 0), 0) > {V.ENGLISH_SHARE}"


def spanish(t: str) -> str:
    words = "|".join(V.SPANISH_WORDS)
    bounded = rf"(?i)(^|[^\p{{L}}\p{{N}}_])({words})([^\p{{L}}\p{{N}}_]|$)"
    return f"regexp_matches({t}, {q(bounded)})"


# --- mining -----------------------------------------------------------------


def walk(template: str, offset: str = "", gate: bool = False, depth: int = V.MAX_DEPTH) -> str:
    """CTE ``hops``: one row per hop of the reply walk, as bag."""
    where = "where " + english("text") if gate else ""
    return f"""with recursive {messages(template, offset)},
tw as (select tweet_id, author_id, text, string_split(response_tweet_id, ',') as nx,
  in_response_to_tweet_id as up from msgs {where}),
e as (select tweet_id as src, unnest(nx)::bigint as dst, unnest(range(len(nx))) as place
  from tw where nx is not null),
hops as (
  select md5(md5(t.tweet_id::varchar) || ':' || r.tweet_id || ':' || e.place) as id,
    [t.author_id] as sender, [t.text] as tweets, r.text as response, r.author_id,
    r.tweet_id as cur, r.nx is not null as open, 0 as depth
  from tw t join e on e.src = t.tweet_id join tw r on r.tweet_id = e.dst
  where t.up is null
  union all
  select md5(h.id || ':' || r.tweet_id || ':' || e.place),
    case when h.sender[-1] = h.author_id then h.sender
         else list_append(h.sender, h.author_id) end,
    case when h.sender[-1] = h.author_id
         then list_append(h.tweets[:-2], h.tweets[-1] || ' ' || h.response)
         else list_append(h.tweets, h.response) end,
    r.text, r.author_id, r.tweet_id, r.nx is not null, h.depth + 1
  from hops h join e on e.src = h.cur join tw r on r.tweet_id = e.dst
  where h.depth < {depth - 1}),
samples as (select * from hops where sender[-1] <> author_id)"""


SAMPLES = """
select id, array_to_string(sender, '|') as sender, array_to_string(tweets, '|') as tweets,
  response, author_id from samples"""

ORACLES["mine_conversations"] = walk(D.REPLY_GRAPH) + SAMPLES
ORACLES["mine_by_ids"] = ORACLES["mine_conversations"]
ORACLES["mine_stored"] = ORACLES["mine_conversations"]
ORACLES["mine_shuffled"] = ORACLES["mine_conversations"]
ORACLES["mine_salted"] = walk(D.HUBS) + SAMPLES
ORACLES["mine_gated"] = walk(D.REPLY_GRAPH, "10000 +", gate=True) + SAMPLES
ORACLES["mine_linear"] = walk(D.LINEAR_GRAPH, gate=True) + SAMPLES
ORACLES["mine_diamonds"] = walk(D.DIAMONDS, gate=True) + SAMPLES
ORACLES["samples_json"] = ORACLES["mine_linear"]
ORACLES["mining_progress"] = walk(D.REPLY_GRAPH) + """
select depth, count(*) filter (where open) as chains,
  cast(sum(count(*) filter (where sender[-1] <> author_id)) over (order by depth) as bigint)
    as samples
from hops group by depth"""
ORACLES["chains_cut_by_depth"] = walk(D.REPLY_GRAPH, depth=6) + """
select count(*) as chains_cut from hops where depth = 5 and open"""
ORACLES["length_histogram"] = walk(D.REPLY_GRAPH) + """
select len(tweets) as length, count(*) as n, round(log10(count(*)), 6) as log_n
from samples group by 1"""
ORACLES["conversation_roots"] = f"""with {messages(D.REPLY_GRAPH)}
select tweet_id, author_id, text from msgs
where in_response_to_tweet_id is null and response_tweet_id is not null"""
ORACLES["open_messages"] = f"""with {messages(D.REPLY_GRAPH)}
select tweet_id, response_tweet_id from msgs where response_tweet_id is not null"""
ORACLES["reply_hops"] = f"""with {messages(D.REPLY_GRAPH)},
e as (select author_id, text, unnest(string_split(response_tweet_id, ','))::bigint as reply_id
  from msgs where response_tweet_id is not null)
select e.author_id, e.text, e.reply_id, r.author_id as reply_author, r.text as reply_text
from e join msgs r on r.tweet_id = e.reply_id where e.author_id <> r.author_id"""
ORACLES["fan_in_merge"] = f"""with {messages(D.DIAMONDS)}
select author_id, response_tweet_id::bigint as next, 1 as rpos,
  string_agg(tweet_id::varchar, ',' order by tweet_id) as tweet_ids,
  string_agg(text, ' ' order by tweet_id) as text
from msgs where in_response_to_tweet_id is null group by author_id, response_tweet_id"""


def fan_walk(template: str, gate: bool = False) -> str:
    """CTE ``paths``: hops of the walk that merges fans before every join."""
    where = "where " + english("text") if gate else ""
    return f"""with recursive {messages(template)},
tw as (select tweet_id, author_id, text, string_split(response_tweet_id, ',') as nx,
  in_response_to_tweet_id as up from msgs {where}),
fronts as (
  select []::varchar[] as sender, []::bigint[][] as context, tweet_id as response, author_id,
    1::bigint as place, nx, -1 as depth
  from tw where up is null and nx is not null
  union all
  select g.sender, g.context, r.tweet_id, r.author_id, g.place, r.nx, g.depth
  from (
    select list_append(sender, author_id) as sender,
      list_append(context, list(response order by place, response, npos)) as context,
      first(npos order by place, response, npos) as place, nxt, depth + 1 as depth
    from (select f.*, unnest(nx)::bigint as nxt, unnest(range(len(nx))) as npos
          from fronts f where nx is not null and depth < {V.MAX_DEPTH - 1})
    group by context, sender, author_id, nxt, depth) g
  join tw r on r.tweet_id = g.nxt),
paths as (select * from fronts where depth >= 0)"""


PATHS = """
select array_to_string(sender, ',') as sender,
  array_to_string(list_transform(context, lambda x: array_to_string(x, '+')), ',') as context,
  response, author_id from paths"""
ORACLES["mine_fan_in"] = fan_walk(D.REPLY_GRAPH) + PATHS
ORACLES["mine_fan_in_diamonds"] = fan_walk(D.DIAMONDS, gate=True) + PATHS
ORACLES["chains_csv"] = fan_walk(D.DIAMONDS, gate=True) + """
select array_to_string(sender, ',') as sender,
  array_to_string(flatten(context), ',') as context, response, author_id from paths"""
ORACLES["rehydrate_paths"] = fan_walk(D.DIAMONDS, gate=True) + """,
p as (select row_number() over () as id, * from paths),
turn as (select id, unnest(context) as ids, unnest(range(len(context))) as place from p),
step as (select id, place, unnest(ids) as tweet_id, unnest(range(len(ids))) as step from turn),
said as (select id, place, string_agg(m.text, ' ' order by step) as text
  from step left join msgs m using (tweet_id) group by id, place),
ctx as (select id, string_agg(coalesce(text, 'NULL'), '|' order by place) as tweets
  from said group by id)
select array_to_string(sender, '|') as sender, tweets, m.text as response, p.author_id
from p join ctx using (id) join msgs m on m.tweet_id = p.response
where len(string_split(m.text, ' ')) > 2"""
ORACLES["context_lookup"] = fan_walk(D.LINEAR_GRAPH) + """,
turn as (select response, unnest(flatten(context)) as tweet_id, unnest(sender) as sender,
  unnest(range(len(sender))) as pos from paths)
select response, pos, sender, tweet_id, m.text
from turn left join (select tweet_id, text from msgs where inbound) m using (tweet_id)"""
ORACLES["context_lookup_gaps"] = ORACLES["context_lookup"].replace("where inbound", "where tweet_id % 11 <> 0")
ORACLES["response_lookup"] = fan_walk(D.LINEAR_GRAPH) + """
select p.response, p.author_id, m.text, len(string_split(m.text, ' ')) as wordcount
from paths p join msgs m on m.tweet_id = p.response where len(string_split(m.text, ' ')) > 2"""
ORACLES["longest_contexts"] = fan_walk(D.REPLY_GRAPH) + """
select len(sender) as length, response, author_id from paths"""


# --- text -------------------------------------------------------------------

NAMES = "|".join(D.ACCOUNTS)
DISALLOWED = V.DISALLOWED_PATTERN


def sub(text: str, pattern: str, to: str) -> str:
    return f"regexp_replace({text}, {q(pattern)}, {q(to)}, 'g')"


def url(t: str) -> str:
    return sub(t, V.URL_PATTERN.removeprefix("(?Ud)"), V.URL_TOKEN)


def phone(t: str) -> str:
    return sub(t, r"([+]*[(]{0,1}[0-9]{1,4}[)]{0,1}[-\s\p{Z}\./0-9]{7,15})", V.PHONE_TOKEN)


def user(t: str) -> str:
    return sub(t, "(@[0-9]{3,})", V.USER_TOKEN)


def bot(t: str) -> str:
    return sub(t, f"(@({NAMES}))", V.BOT_TOKEN)


def signature(t: str, form: str = "strict") -> str:
    times = "" if form == "strict" else "*"
    return sub(t, rf"[-/\^]{times} *[A-Z]{{1,2}}{WORD}*(\n?)$", V.SIGNATURE_TOKEN + r"\1")


def allowed(t: str) -> str:
    return sub(t, DISALLOWED, "")


def clean(t: str, form: str = "strict") -> str:
    return f"trim({allowed(signature(bot(user(phone(url(t)))), form))}, E' \\n')"


def noisy(expression: str) -> str:
    return (
        f"with noisy as ({D.on_duckdb(D.NOISY_TEXTS)})\n"
        f"select doc_id, {expression} as text from noisy"
    )


ORACLES["clean_text"] = noisy(clean("text"))
ORACLES["clean_text_loose"] = noisy(clean("text", "loose"))
ORACLES["mask_urls"] = noisy(url("text"))
ORACLES["mask_phones"] = noisy(phone("text"))
ORACLES["mask_users"] = noisy(user("text"))
ORACLES["mask_bots"] = noisy(bot("text"))
ORACLES["mask_signature"] = noisy(signature("text"))
ORACLES["mask_signature_loose"] = noisy(signature("text", "loose"))
ORACLES["drop_disallowed"] = noisy(allowed("text"))
ORACLES["placeholder_split"] = f"""with cleaned as ({noisy(clean("text"))})
select doc_id, array_to_string(string_split_regex(text, {q(TOKEN)}), '|') as pieces,
  array_to_string(regexp_extract_all(text, {q(TOKEN)}), '|') as tokens from cleaned"""
ORACLES["english_gate"] = f"""with {messages(D.REPLY_GRAPH, "10000 +")}
select tweet_id, {english("text")} as is_english from msgs"""
ORACLES["english_documents"] = (
    f"select doc_id, text from documents where {english('text')}"
)
ORACLES["spanish_gate"] = (
    f"select doc_id, text from documents where not {spanish('text')}"
)
ORACLES["empty_gate"] = r"""select doc_id, text from (
  select doc_id, regexp_replace(text, '[A-Za-z .,\n]', '', 'g') as text from documents)
where length(text) <> 0"""
ORACLES["none_links"] = f"""with {messages(D.REPLY_GRAPH)}
select tweet_id, coalesce(response_tweet_id, 'none') as response_tweet_id,
  coalesce(in_response_to_tweet_id::varchar, 'none') as in_response_to_tweet_id from msgs"""
ORACLES["min_words"] = f"""with {messages(D.LINEAR_GRAPH)}
select tweet_id, len(string_split(text, ' ')) as wordcount from msgs
where len(string_split(text, ' ')) > 2"""
ORACLES["discover_accounts"] = f"""with {messages(D.LINEAR_GRAPH)}
select distinct author_id from msgs
where not inbound and regexp_matches(author_id, '^[^0-9]*$')"""
ORACLES["distinct_authors"] = f"""with {messages(D.LINEAR_GRAPH)}
select distinct author_id from msgs"""


# --- counts and reports -----------------------------------------------------

ORACLES["row_counts"] = f"""with {messages(D.REPLY_GRAPH, "10000 +")}
select count(*) as n from msgs where {english("text")}"""
CHARS = "regexp_extract_all({t}, '(?s).')"
CHAR_COUNTS = f"""select character, count(*) as n
from (select unnest({CHARS.format(t="text")}) as character from documents) group by character"""
ORACLES["char_frequency"] = CHAR_COUNTS
ORACLES["running_lists"] = """select conv_id, turn,
  string_agg(role, ',') over w as roles, first_value(role) over w as first_role
from conversations window w as (partition by conv_id order by turn)"""
ORACLES["top_texts"] = """select doc_id, lang, n_chars from documents
order by n_chars desc, doc_id limit 20"""


# --- authors and speakers ---------------------------------------------------

AUTHORS = f"""authors as (select author_id, row_number() over (order by author_id)::int as code
  from (select author_id from ({D.on_duckdb(D.REPLY_GRAPH)}) g
          where not inbound and regexp_matches(author_id, '^[^0-9]*$')
        union select unnest([{', '.join(q(a) for a in D.ACCOUNTS)}])))"""
ORACLES["author_file"] = f"with {AUTHORS} select author_id, code from authors"
ORACLES["author_codes"] = f"""with {messages(D.LINEAR_GRAPH)}, {AUTHORS}
select tweet_id, author_id, coalesce(code, 0) as author_code
from msgs left join authors using (author_id)"""
ORACLES["speaker_ids"] = walk(D.LINEAR_GRAPH) + f""", {AUTHORS},
turn as (select id, unnest(sender) as author_id, unnest(tweets) as said,
  unnest(range(len(sender))) as pos from samples),
ctx as (select id, string_agg(
    repeat(case when code is null then '1' else '2' end, len(string_split(said, ' '))::int), ''
    order by pos) as sender_ids
  from turn left join authors using (author_id) group by id)
select s.id, sender_ids, case when a.code is null then 1 else 2 end as author_class
from samples s join ctx using (id) left join authors a on a.author_id = s.author_id"""
ORACLES["speaker_ids_joined"] = ORACLES["speaker_ids"]


# --- subwords ---------------------------------------------------------------

WORDS = f"""words as (select '▁' || w as word, count(*) as n
  from (select unnest(string_split_regex(text, {q(TOKEN + '|[ ' + chr(10) + ']+')})) as w
        from documents) where w <> '' group by w)"""
SPACED = r"regexp_replace(word, '(.)', ' \1 ', 'g')"


def pairs(source: str) -> str:
    return f"""select l as "left", r as "right", sum(n)::bigint as n
  from (select unnest(s[:-2]) as l, unnest(s[2:]) as r, n
        from (select string_split(trim(spaced, ' '), '  ') as s, n from {source}))
  group by l, r"""


def merge_chain(merges: int) -> str:
    """CTEs ``words``, ``s0`` .. and ``merges``: one merge after the other."""
    parts = [WORDS, f"s0 as materialized (select {SPACED} as spaced, n from words)"]
    for i in range(merges):
        parts.append(
            f'p{i} as materialized (select "left" as l, "right" as r from ({pairs(f"s{i}")})'
            f' order by n desc, "left", "right" limit 1)'
        )
        parts.append(
            f"s{i + 1} as materialized (select replace(spaced, ' ' || l || '  ' || r || ' ',"
            f" ' ' || l || r || ' ') as spaced, n from s{i}, p{i})"
        )
    learned = " union all ".join(f"select {i} as rank, l, r from p{i}" for i in range(merges))
    parts.append(f"merges as materialized ({learned})")
    return ",\n".join(parts)


def vocabulary() -> str:
    """CTEs ``base`` and ``vocab``; expects ``words`` and ``merges``."""
    specials = ", ".join(f"(0, {i}, {q(s)})" for i, s in enumerate(V.BASE_SPECIALS))
    extra = ", ".join(f"({i}, {q(s)})" for i, s in enumerate(V.PLACEHOLDERS))
    return f"""base as materialized (
  select subword, row_number() over (order by kind, place, subword) - 1 as id from (
    select * from (values {specials}) t(kind, place, subword)
    union all select 1, min(rank), l || r from merges group by l || r
    union all select 2, -sum(n), c from (
      select unnest({CHARS.format(t="word")}) as c, n from words) group by c)),
vocab as materialized (select subword, id from base
  union all select s, (select max(id) + 1 from base) + i from (values {extra}) t(i, s))"""


def encoder(texts: str, merges: int) -> str:
    """CTE ``coded (text, ids)`` of cleaned turns; expects ``p0`` .. and ``vocab``."""
    replaced = "spaced"
    chain = [f"e0 as (select word, {SPACED} as spaced from (select distinct '▁' || item as word"
             " from items where not starts_with(item, chr(2))))"]
    for i in range(merges):
        chain.append(
            f"e{i + 1} as (select word, replace({replaced}, ' ' || l || '  ' || r || ' ',"
            f" ' ' || l || r || ' ') as spaced from e{i}, p{i})"
        )
    marked = rf"regexp_replace(text, {q('(' + TOKEN + ')')}, E' \x02' || '\1' || ' ', 'g')"
    return f"""turns as materialized (select distinct text from ({texts})),
items as materialized (select text, item, place from (
  select text, unnest(i) as item, unnest(range(len(i))) as place
  from (select text, string_split_regex({marked}, '[ \n]+') as i from turns))
  where item <> ''),
{", ".join(chain)},
split as materialized (select word, string_split(trim(spaced, ' '), '  ') as subs
  from e{merges}),
bits as (
  select text, place, unnest(subs) as subword, unnest(range(len(subs))) as step
  from items join split on split.word = '▁' || item where not starts_with(item, chr(2))
  union all
  select text, place, item[2:], 0 from items where starts_with(item, chr(2))),
inner_ids as (select text, list(coalesce(v.id, 0) order by place, step) as ids
  from bits left join vocab v using (subword) group by text),
coded as materialized (select text, list_concat([1], coalesce(ids, []),
    [(select id from vocab where subword = ''), 2]) as ids
  from turns left join inner_ids using (text))"""


ORACLES["word_counts"] = f"with {WORDS} select word, n from words"
ORACLES["pair_counts"] = (
    f"with {WORDS}, s0 as (select {SPACED} as spaced, n from words) {pairs('s0')}"
)
ORACLES["learn_merges"] = (
    f'with {merge_chain(MERGES)} select rank, l as "left", r as "right" from merges'
)
ORACLES["learn_vocabulary"] = (
    f"with {merge_chain(MERGES)}, {vocabulary()} select subword, id from vocab"
)
ORACLES["encode_turns"] = f"""with {merge_chain(MERGES)}, {vocabulary()},
cleaned as materialized ({noisy(clean("text"))}), {encoder("select text from cleaned", MERGES)}
select doc_id, array_to_string(ids, ' ') as ids from cleaned join coded using (text)"""
LETTERS = f"""letters as (select tweet_id, unnest(c) as subword, unnest(range(len(c))) as pos
  from (select tweet_id, {CHARS.format(t="text")} as c from msgs)),
vocab as (select character as subword, row_number() over (order by n desc, character) as id
  from ({CHAR_COUNTS}))"""
ORACLES["word_vectors"] = f"""with {messages(D.LINEAR_GRAPH)}, {LETTERS}
select distinct coalesce(id, 0)::int as id, 16 as dim from letters left join vocab using (subword)"""
ORACLES["vocab_lookup"] = f"""with {messages(D.LINEAR_GRAPH)}, {LETTERS}
select tweet_id, string_agg(coalesce(id, 0)::varchar, ' ' order by pos) as ids
from letters left join vocab using (subword) group by tweet_id"""
ORACLES["decode_ids"] = f"""with {messages(D.LINEAR_GRAPH)}, {LETTERS}
select tweet_id, trim(string_agg(subword, '' order by pos), ' ') as text
from letters join vocab using (subword) group by tweet_id"""


# --- packing ----------------------------------------------------------------


def padded(ids: str, n: int = V.SEQUENCE_LENGTH) -> str:
    return f"list_concat(repeat([0], greatest({n} - len({ids}), 0)::int), {ids})[-{n}:]"


SIZES = f"""{messages(D.LINEAR_GRAPH)}, sized as (select tweet_id,
  list_transform(string_split(text, ' '), lambda w: length(w)) as ids from msgs)"""
ORACLES["left_pad"] = f"""with {SIZES}
select tweet_id, array_to_string({padded("ids", 16)}, ',') as padded from sized"""
ORACLES["padding_mask"] = f"""with {SIZES} select tweet_id, array_to_string(list_transform(
  {padded("ids", 16)}, lambda x: (x <> 0)::int), '') as mask from sized"""
BAD = f"({spanish('t')} or length(t) = 0)"
ORACLES["valid_samples"] = walk(D.CHATTY_GRAPH) + f"""
select id, case
  when len(list_filter(tweets, lambda t: length(t) = 0)) > 0 then 'empty turn'
  when len(list_filter(tweets, lambda t: {spanish("t")})) > 0 then 'spanish turn'
  when length(response) = 0 then 'empty response'
  when {spanish("response")} then 'spanish response' end as reject_reason
from samples"""
PACKED = walk(D.CHATTY_GRAPH) + f""", {AUTHORS}, {merge_chain(PACK_MERGES)}, {vocabulary()},
good as materialized (select * from samples
  where len(list_filter(list_append(tweets, response), lambda t: {BAD})) = 0),
cleaned as materialized (select raw, {clean("raw")} as text from (
  select distinct unnest(list_append(tweets, response)) as raw from good)),
{encoder("select text from cleaned", PACK_MERGES)},
said as materialized (select raw, ids from cleaned join coded using (text)),
turn as (select id, unnest(sender) as author_id, unnest(tweets) as raw,
  unnest(range(len(sender))) as pos from good),
ctx as (select id, flatten(list(ids order by pos)) as context,
    flatten(list(list_transform(ids, lambda x: case when code is null then 1 else 2 end)
      order by pos)) as sender_ids
  from turn join said using (raw) left join authors using (author_id) group by id),
packed as (select g.id, {padded("c.context")} as context, {padded("c.sender_ids")} as sender_ids,
    {padded("s.ids")} as response_ids,
    {padded("list_transform(s.ids, lambda x: case when a.code is null then 1 else 2 end)")}
      as author_ids
  from good g join ctx c using (id) join said s on s.raw = g.response
  left join authors a on a.author_id = g.author_id where len(s.ids) <= {V.MAX_RESPONSE_IDS})"""
ORACLES["pack_samples"] = PACKED + """
select id, array_to_string(flatten([context, sender_ids, response_ids, author_ids]), ',') as line
from packed"""
ORACLES["prepared_rows"] = PACKED + """
select id, array_to_string(flatten([context, sender_ids, response_ids, author_ids]), ',') as line,
  case when md5('1234:' || id)[1:8] < '1999999a' then 'test' else 'train' end as split
from packed"""
ORACLES["unpack_rows"] = PACKED + """
select array_to_string(context, ',') as context, array_to_string(sender_ids, ',') as sender_ids,
  array_to_string(response_ids, ',') as response_ids,
  array_to_string(author_ids, ',') as author_ids, null::varchar as bad_record from packed"""
SPLIT = (
    "case when md5('1234:' || event_id)[1:8] < '00c49ba6' then 'test' else 'train' end as split"
)
ORACLES["split_samples"] = f"select event_id, {SPLIT} from events"
ORACLES["split_sink"] = f"select event_id, event_type, {SPLIT} from events"
ORACLES["batch_feed"] = """
select event_id, bucket, place // 32 as batch_no, place % 32 as slot from (
  select event_id, bucket,
    row_number() over (partition by bucket order by digest, event_id) - 1 as place
  from (select event_id, digest, ('0x' || digest[1:8])::bigint % 8 as bucket
        from (select event_id, md5('1234:0:' || event_id) as digest from events)))"""


# --- scoring and selection --------------------------------------------------

ITEMS = f"""items as (select batch_id, slot, is_context, vec_id, embedding::double[] as v
  from ({D.on_duckdb(D.SCORE_ITEMS)})),
c as (select * from items where is_context), r as (select * from items where not is_context),
scores as (select c.batch_id, c.slot as i, r.slot as j, list_dot_product(c.v, r.v) as score
  from c join r using (batch_id))"""
ORACLES["score_matrix"] = f"with {ITEMS} select batch_id, i, j, round(score, 6) as score from scores"
ORACLES["sigmoid_scores"] = (
    f"with {ITEMS} select batch_id, i, j, round(1 / (1 + exp(-score)), 6) as score from scores"
)


def losses(margin: float) -> str:
    return f"""with {ITEMS},
d as (select batch_id, i, score as pos from scores where i = j),
t as (select s.*, pos, s.i <> s.j as neg, s.i <> s.j and score - pos + {margin} > 0 as rel
  from scores s join d using (batch_id, i)),
anchors as (select batch_id, i, count(*) filter (where rel) as n_relevant,
  coalesce(greatest(avg(score) filter (where rel) - max(pos) + {margin}, 0), 0) as loss,
  coalesce(greatest(avg(score) filter (where neg) - max(pos) + {margin}, 0), 0) as all_loss
  from t group by batch_id, i)"""


BATCH_LOSS = """
select batch_id, round(avg(loss), 6) as loss, round(avg(all_loss), 6) as all_loss,
  sum(n_relevant)::bigint as n_relevant, count(*) filter (where n_relevant = 0) as no_hard
from anchors group by batch_id"""
ORACLES["triplet_loss"] = losses(V.TRIPLET_MARGIN) + BATCH_LOSS
ORACLES["triplet_loss_narrow"] = losses(0.05) + BATCH_LOSS
ORACLES["anchor_losses"] = losses(0.05) + """
select batch_id, i, n_relevant, round(loss, 6) as loss, round(all_loss, 6) as all_loss,
  n_relevant = 0 as no_hard from anchors"""
ORACLES["hard_triplets"] = losses(0.05) + """
select batch_id, i as anchor, j as negative, round(pos, 6) as positive_score,
  round(score, 6) as negative_score,
  case when score > pos then 'hard' else 'semi-hard' end as kind from t where rel"""
ORACLES["select_responses"] = f"""with {ITEMS}, ranked as (
  select context_id, response_id, score,
    row_number() over (partition by context_id order by score desc, response_id) as rank
  from (select c.vec_id as context_id, r.vec_id as response_id,
          round(list_dot_product(c.v, r.v), 9) as score from c, r))
select context_id, response_id, round(score, 6) as score, rank from ranked where rank <= 5"""
ORACLES["select_responses_blocked"] = ORACLES["select_responses"]
TOKENS = """tokens as (select doc_id, (length(w) * 7 + i) % 450 as id
  from (select doc_id, unnest(ws) as w, unnest(range(len(ws))) as i
        from (select doc_id, string_split(text, ' ') as ws from documents)))"""
ORACLES["mean_pool"] = f"""with {TOKENS},
counted as (select doc_id, id, count(*) as n from tokens where id <> 0 group by doc_id, id),
cells as (select vec_id as id, unnest(embedding)::double as x,
  unnest(range(len(embedding))) as dim from embeddings)
select doc_id, dim, round(sum(n * x) / sum(n), 6) as value
from counted join cells using (id) group by doc_id, dim"""
MILLIONTHS = (
    "array_to_string(list_transform(embedding, lambda x: round(x::double * 1e6)::bigint::varchar), ',')"
)
ORACLES["mask_many_accounts"] = f"""with handles as (
  select o_orderkey, 'C' || o_custkey as handle from orders),
debtors as (select 'C' || c_custkey as name, c_custkey from customer where c_acctbal < 0),
first as (select handle, first(name order by c_custkey) as name
  from (select distinct handle from handles) join debtors on starts_with(handle, name) group by handle)
select o_orderkey, 'hi ' || coalesce('{V.BOT_TOKEN}' || substr(handle, length(name) + 1), '@' || handle) || ' bye'
  as text from handles left join first using (handle)"""
ORACLES["mean_pool_joined"] = ORACLES["mean_pool"]
ORACLES["vector_lookup"] = f"""with {SIZES},
ids as (select tweet_id, unnest(ids) as id, unnest(range(len(ids))) as pos from sized)
select tweet_id, pos, id, md5({MILLIONTHS}) as vector
from ids left join embeddings on vec_id = id"""
ORACLES["logistic_score"] = f"""select vec_id as id, round(1 / (1 + exp(
  -(list_dot_product(embedding::double[], {WEIGHTS}::double[]) + 0.25))), 6) as score
from embeddings"""
UNIFORM = "((('0x' || md5({k})[1:8])::bigint + 0.5) / 4294967296.0)"
ORACLES["embedding_table"] = f"""with n as (select count(*) as n from embeddings),
ids as (select unnest(range((select n + 7 from n))) as id),
cells as (select id, unnest(range(64)) as dim from ids),
known as (select vec_id as id, unnest(embedding)::double as x,
  unnest(range(len(embedding))) as dim from embeddings where vec_id % 2 = 0),
filled as (select id, dim, round(coalesce(x, (
  sqrt(-2 * ln({UNIFORM.format(k="'7:' || id || ':' || dim || ':a'")}))
  * cos(2 * pi() * {UNIFORM.format(k="'7:' || id || ':' || dim || ':b'")}))::float::double), 4)
  as value from cells left join known using (id, dim))
select id, dim, case when value = 0 then 0 else value end as value from filled"""


# --- metrics ----------------------------------------------------------------

STEPS = """steps as (select event_id // 880 as epoch, event_id % 880 as step,
  value as loss, value * 2 as all_loss from events)"""
ORACLES["metric_rollup"] = f"""with {STEPS}
select epoch, report, count(*) as steps, max(step) as last_step, round(avg(loss), 6) as loss,
  round(avg(all_loss), 6) as all_loss, max(step) = report * 50 as reported
from (select *, ceil(step / 50.0)::bigint as report from steps) group by epoch, report"""
ORACLES["evaluation_means"] = f"""with {STEPS}
select epoch, round(avg(loss), 6) as loss, round(avg(all_loss), 6) as all_loss
from steps group by epoch"""
ORACLES["weighted_cross_entropy"] = """with cells as (
  select vec_id, unnest(embedding)::double as x, unnest(range(64)) as k from embeddings),
ce as (select vec_id, ln(sum(exp(x))) - max(x) filter (where k = vec_id % 64) as ce,
  case when vec_id % 3 = 0 then 0 else 1 end as w from cells group by vec_id)
select round(sum(w * ce) / count(*), 6) as loss, round(sum(w * ce) / sum(w), 6) as metric from ce"""


# --- files ------------------------------------------------------------------

ORACLES["messages_csv"] = f"""with {messages(D.LINEAR_GRAPH)}
select tweet_id, author_id, inbound, text, response_tweet_id, in_response_to_tweet_id from msgs"""
ORACLES["messages_csv_split"] = ORACLES["messages_csv"]
ORACLES["corpus_text"] = f"""with {messages(D.LINEAR_GRAPH)}
select regexp_replace({clean("text", "loose")}, '[\\r\\n]', ' ', 'g') as text
from msgs where {english("text")}"""
ORACLES["vocab_file"] = rf"""select character as subword,
  (row_number() over (order by n desc, character) - 1)::int as id from ({CHAR_COUNTS})
where regexp_matches(character, '^[\p{{L}}\p{{N}}]$')"""
# entries are stripped, and of equal ones the last counts
ORACLES["vocab_file_all"] = f"""select trim(character, ' ' || chr(9) || chr(13)) as subword, max(id)::int as id
from (select character, row_number() over (order by n desc, character) - 1 as id
      from ({CHAR_COUNTS}) where character <> chr(10)) group by 1"""
ORACLES["embeddings_sink"] = f"select vec_id as id, {MILLIONTHS} as vector from embeddings"
ORACLES["sql_view"] = f"""with {messages(D.LINEAR_GRAPH)}
select author_id, count(*) as n from msgs group by author_id"""


# --- unigram pieces, digits, positions and chains -------------------------------

SEEDS_SQL = rf"""{{words}},
subs as (select substring(word, i, l) as piece, n
  from (select word, n, i, unnest(range(1, least({{longest}}, length(word) - i + 1) + 1)) as l
        from (select word, n, unnest(range(1, length(word) + 1)) as i from words))),
summed as (select piece, sum(n)::bigint as n, (sum(n) * length(piece))::bigint as gain
  from subs group by piece),
seeds as materialized (select * from summed where length(piece) = 1
  union all select * from (select * from summed where length(piece) > 1 and n > 1
    order by gain desc, piece limit {{size}}))""".format(
    words=f"""marked as materialized ({D.on_duckdb(D.MARKED_TURNS)}),
""" + WORDS.replace("from documents", "from marked"),
    longest=6,
    size=300,
)
PROTECTED = [p.strip() for p in V.PLACEHOLDERS if p.strip()]
FIXED_ENTRIES = ", ".join(
    [f"(0, {i}, {q(t)}, 0)" for i, t in enumerate(V.BASE_SPECIALS)]
    + [f"(1, {i}, {q(t)}, 0)" for i, t in enumerate(PROTECTED)]
)
UNIGRAM_SQL = f"""{SEEDS_SQL},
scored as (select piece, round(ln(gain / (select sum(gain) from seeds)) * 1000000)::bigint as score
  from seeds),
vocab as materialized (select subword, row_number() over (order by kind, place, subword) - 1 as id, score
  from (select * from (values {FIXED_ENTRIES}) t(kind, place, subword, score)
        union all select 2, -score, piece, score from scored
          where piece not in ({", ".join(q(t) for t in [*V.BASE_SPECIALS, *PROTECTED])})))"""
ORACLES["unigram_seeds"] = f"with {SEEDS_SQL} select piece, n, gain from seeds"
ORACLES["unigram_vocabulary"] = f"with {UNIGRAM_SQL} select subword, id, score from vocab"

# The best segmentation of a word, end by end; of equal scores the longest last piece.
MARK = "chr(2)"
ORACLES["digit_sentences"] = f"""with recursive {UNIGRAM_SQL},
pieces as materialized (select subword as piece, id, score from vocab where id >= {len(V.BASE_SPECIALS) + len(PROTECTED)}),
vit(word, e, best, path) as (
  select word, 0, [0::bigint], [''] from words
  union all
  select p.word, p.e + 1,
    list_append(any_value(p.best), max(p.best[p.e + 2 - l] + v.score)),
    list_append(any_value(p.path), arg_max(p.path[p.e + 2 - l] || ' ' || v.id,
      (p.best[p.e + 2 - l] + v.score) * 100 + l))
  from vit p cross join (select unnest(range(1, 7)) as l) s
  join pieces v on v.piece = substring(p.word, p.e + 2 - l, l)
  where l <= p.e + 1 and p.e < length(p.word)
  group by p.word, p.e),
coded as materialized (select word, path[e + 1] as ids from vit where e = length(word)),
items as (select tweet_id, item, place
  from (select tweet_id, unnest(i) as item, unnest(range(len(i))) as place
    from (select tweet_id, string_split_regex(regexp_replace(text, {q("(" + TOKEN + ")")},
      ' ' || chr(2) || '\\1 ', 'g'), '[ \n]+') as i from marked)) where item <> ''),
bits as (
  select tweet_id, place, ids from items join coded on coded.word = '▁' || item where not starts_with(item, chr(2))
  union all
  select tweet_id, place, ' ' || coalesce(v.id, 0) from items left join vocab v
    on v.subword = item[2:] and v.id between {len(V.BASE_SPECIALS)} and {len(V.BASE_SPECIALS) + len(PROTECTED) - 1}
    where starts_with(item, chr(2))),
whole as (select tweet_id, string_agg(ids, '' order by place) as ids from bits group by tweet_id)
select tweet_id, '1' || coalesce(ids, '') || ' 2' as sentence from marked left join whole using (tweet_id)"""
ORACLES["noise_table"] = f"""with {messages(D.LINEAR_GRAPH)},
tokens as (select unnest(list_transform(string_split(text, ' '), lambda w: length(w))) as token from msgs),
counts as (select token, count(*) as n from tokens group by token)
select token, n, round(pow(n, 0.75) / (select sum(pow(n, 0.75)) from counts), 9) as share from counts"""
FEED_SQL = """select event_id, place // 32 as batch_no, place % 32 as slot from (
  select event_id, row_number() over (order by md5('1234:{epoch}:' || event_id), event_id) - 1 as place
  from events)"""
ORACLES["batch_feed_global"] = FEED_SQL.format(epoch=0)
ORACLES["batch_feed_resumed"] = FEED_SQL.format(epoch=3) + " where place // 32 >= 10"
ORACLES["running_parts"] = """select conv_id, (i - 1) // 3 as part,
  string_agg(coalesce(role, ' '), ',' order by i) as roles
from (select *, row_number() over (partition by conv_id order by turn) as i from conversations)
group by conv_id, (i - 1) // 3"""
ORACLES["fan_in_parts"] = f"""select context, author_id, next, (i - 1) // 50 as part,
  min(rpos) as rpos, string_agg(tweet_id::varchar, ',' order by i) as tweet_ids,
  string_agg(text, ' ' order by i) as text
from (select *, row_number() over (partition by context, author_id, next order by rpos, tweet_id) as i
      from ({D.on_duckdb(D.CROWDS)}))
group by context, author_id, next, (i - 1) // 50"""
RINGS_SQL = f"""with recursive g as materialized (select tweet_id, in_response_to_tweet_id as up
  from ({D.on_duckdb(D.RINGS)})),
down as (select tweet_id, tweet_id as root, 0::bigint as depth from g
    where up is null or up not in (select tweet_id from g)
  union all select g.tweet_id, d.root, d.depth + 1 from g join down d on g.up = d.tweet_id)"""
ORACLES["reply_depths"] = RINGS_SQL + " select tweet_id, root, depth from down"
ORACLES["reply_cycles"] = RINGS_SQL + """,
rest as materialized (select * from g where tweet_id not in (select tweet_id from down)),
ringed as (select tweet_id as start, up as here, least(tweet_id, up) as low, 1 as steps from rest
  union all select start, g.up, least(low, g.up), steps + 1 from ringed join g on g.tweet_id = here
    where here <> start and steps < 1000)
select start as tweet_id, low as root from ringed where here = start"""
