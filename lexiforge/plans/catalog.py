"""Registered queries over the text tables, and their DuckDB SQL.

RE2 has neither lookaround nor Unicode word boundaries. A bounded term is written
with the neighbours captured and put out again; as a match takes its neighbours,
such a replacement runs twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineMode, PostEditSettings, RunConfig
from ..functions import plain
from ..functions import text as tx
from ..operators import chunks, engines, glossary, postedit, routing, segments, tokens
from ..sources import sinks
from . import reports
from .translate import translated, translated_text

#: Common words of the test languages: the casing and boundary rules all apply.
TERMS: plain.Entries = (("the", "le"), ("with", "avec"), ("les", "the ones"), ("que", "that"), ("und", "und so"), ("for the", "pour le"))
TARGETS = [t for _, t in TERMS]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.units_of(table(spark, sf_dir, "documents").select("doc_id", "text"))


def doc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segment(doc_units(spark, sf_dir))


def derived(idx: str = "seg_idx") -> Column:
    """Drafts with technical tokens, placeholders and further sentences in some rows."""
    i, c = F.col(idx), F.col("text")
    more = F.when(i % 7 == 0, " see http://x.example --flag").when(i % 11 == 0, " __LT_A_0001__ and __LT_B_0002____LT_C__").when(i % 13 == 0, ". Next one. And").otherwise("")
    return F.concat(c, more)


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_segments(spark, sf_dir).withColumn("draft", derived())


CHUNKED = PostEditSettings(enable_chunking=True, policy="auto", skip_short_characters=30)


# --- SQL parts

RS = "chr(30)"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _split(x: str) -> str:
    return f"string_split(regexp_replace({x}, '([.!?])\\s+', '\\1' || {RS}, 'g'), {RS})"


def _pieces(x: str) -> str:
    return f"list_filter(list_transform({_split(x)}, lambda p: {_strip('p')}), lambda p: p <> '')"


def _sentences(x: str) -> str:
    return f"case when {_strip(x)} = '' or len({_pieces(x)}) = 0 then [{x}] else {_pieces(x)} end"


SEG = f"""seg as (
  select doc_id, lang, unnest(s) as text, generate_subscripts(s, 1) - 1 as seg_idx
  from (select doc_id, lang, {_sentences('text')} as s from documents where text is not null))"""

DERIVED = "text || case when seg_idx % 7 = 0 then ' see http://x.example --flag' when seg_idx % 11 = 0 then ' __LT_A_0001__ and __LT_B_0002____LT_C__' when seg_idx % 13 = 0 then '. Next one. And' else '' end"
DRAFT = f"draft as (select doc_id, lang, seg_idx, {DERIVED} as draft from seg)"
TECHNICAL = " + ".join(f"cast(contains(draft, '{s}') as int)" for s in tx.TECHNICAL)
MARKS = "cast((length(draft) - length(replace(draft, '__LT_', ''))) / 5 as int)"
FEATURES = f"""feat as (
  select *, length(draft) as char_count, len(regexp_extract_all(draft, '__LT_[A-Z0-9_]+__')) as placeholder_count, {TECHNICAL} as technical_token_count,
    greatest(1, len({_pieces('draft')})) as sentence_count, {MARKS} as mark_count
  from draft)"""


def _routed(s: PostEditSettings) -> str:
    mode = [f"when char_count < {s.skip_short_characters} then null", f"when placeholder_count / greatest(1, char_count) > {s.skip_high_placeholder_ratio} then null"]
    why = [f"when char_count < {s.skip_short_characters} then 'short_plain_segment'", f"when placeholder_count / greatest(1, char_count) > {s.skip_high_placeholder_ratio} then 'high_placeholder_density'"]
    if s.policy == "off":
        mode, why = ["when true then null"], ["when true then 'mode_off'"]
    elif s.policy != "auto":
        mode.append(f"when true then '{s.policy}'")
        why.append("when true then 'forced_mode'")
    rules = (("technical_token_count >= 1", "safe", "technical_token_density"), ("placeholder_count >= 2", "safe", "high_placeholder_density"), ("sentence_count >= 2", "smart", "multi_sentence_prose"), ("char_count >= 160", "smart", "long_natural_language_segment"))
    mode += [f"when {c} then '{m}'" for c, m, _ in rules]
    why += [f"when {c} then '{r}'" for c, _, r in rules]
    return f"routed as (select *, case {' '.join(mode)} else 'safe' end as mode, case {' '.join(why)} else 'default_safe' end as reason from feat)"


def _with(*parts: str, recursive: bool = False) -> str:
    return f"with {'recursive ' * recursive}" + ",\n".join(parts) + "\n"


def _bounded_sub(x: str, term: str, by: str) -> str:
    once = lambda y: f"regexp_replace({y}, '(^|[^\\pL\\pN_])((?i){term})($|[^\\pL\\pN_])', '\\1{by}\\3', 'g')"
    return once(once(x))


def _glossary_sql(label: str, start: str = "select doc_id, seg_idx, text as t from seg", g: str = "g") -> str:
    """Steps of the fold, each from the one before: t0, t1, ..."""
    steps, targets = [f"{g}0 as ({start})"], dict(TERMS)
    for k, term in enumerate(plain.by_length(targets)):
        last = f"regexp_extract(t, '(?s)^(?:.*[^\\pL\\pN_])?((?i){term})(?:[^\\pL\\pN_]|$)', 1)"
        kept = "".join(f", m{j}" for j in range(k))
        steps.append(f"{g}{k + 1} as (select doc_id, seg_idx, {_bounded_sub('t', term, label % k)} as t{kept}, {last} as m{k} from {g}{k})")
    return ",\n".join(steps)


def _cased_sql(m: str, target: str) -> str:
    title = target[:1].upper() + target[1:]
    rest = f"substr({m}, 2)"
    return f"case when upper({m}) = {m} and lower({m}) <> {m} then '{target.upper()}' when upper({m}[1]) = {m}[1] and lower({m}[1]) <> {m}[1] and lower({rest}) = {rest} and upper({rest}) <> {rest} then '{title}' else '{target}' end"


def _swapped_sql(x: str, label: str) -> str:
    targets = dict(TERMS)
    for k, term in enumerate(plain.by_length(targets)):
        x = f"replace({x}, '{label % k}', {_cased_sql(f'm{k}', targets[term])})"
    return x


def _count_sql(label: str) -> str:
    return " + ".join(f"cast((length(t) - length(replace(t, '{label % k}', ''))) / {len(label % k)} as bigint)" for k in range(len(TERMS)))


def _spaced_sql(x: str) -> str:
    once = lambda y: f"regexp_replace({y}, '([^\\s])[ \\t]{{2,}}([^\\s])', '\\1 \\2', 'g')"
    return once(once(x))


N = len(TERMS)
LAST = f"g{N}"

PACKED = f"""ordered as (
  select doc_id, cast(seg_idx as int) as seg_idx, length(draft) as chars, mark_count as marks, mode,
    mode is not null and char_count >= 1 and mark_count <= 1 and technical_token_count = 0 as can
  from routed),
packed as (
  select doc_id, seg_idx, can, mode as chunk_mode, case when can then 1 else 0 end as size, case when can then chars else 0 end as total, case when can then 0 else -1 end as chunk,
    cast(null as varchar) as closed, case when can then null else '{chunks.MODE_CHANGE}' end as carried
  from ordered where seg_idx = 0
  union all
  select o.doc_id, o.seg_idx, o.can, case when o.can and (p.size = 0 or p.size >= 4 or p.total + o.chars > 560) then o.mode else p.chunk_mode end,
    case when not o.can then 0 when p.size = 0 or p.size >= 4 or p.total + o.chars > 560 then 1 else p.size + 1 end,
    case when not o.can then 0 when p.size = 0 or p.size >= 4 or p.total + o.chars > 560 then o.chars else p.total + o.chars end,
    case when o.can and (p.size = 0 or p.size >= 4 or p.total + o.chars > 560) then p.chunk + 1 + cast(p.chunk = -1 and not p.can as int) * 0 else p.chunk end,
    case when p.size > 0 and not o.can then '{chunks.MODE_CHANGE}' when p.size >= 4 then '{chunks.MAX_SEGMENTS}' when p.size > 0 and o.can and p.total + o.chars > 560 then '{chunks.MAX_CHARS}' end,
    case when not o.can and p.size = 0 then '{chunks.MODE_CHANGE}' when not o.can then null when p.size = 0 then p.carried when p.size >= 4 or p.total + o.chars > 560 then null else p.carried end
  from packed p join ordered o on o.doc_id = p.doc_id and o.seg_idx = p.seg_idx + 1),
ends as (select *, lead(closed) over w as after, lead(seg_idx) over w as more from packed window w as (partition by doc_id order by seg_idx)),
plan as (
  select e.doc_id, e.chunk, min(e.seg_idx) as first_segment, count(*) as n_segments, sum(o.chars) as character_count, sum(o.marks) as placeholder_count,
    min(e.chunk_mode) as routing_mode, coalesce(max(e.after), max(case when e.more is null then e.carried end)) as boundary_reason
  from ends e join ordered o using (doc_id, seg_idx) where e.can group by all)"""


# --- queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


@query(_with(SEG) + "select doc_id, cast(seg_idx as bigint) as seg_idx, text from seg")
def segment_documents(spark, sf_dir):
    return doc_segments(spark, sf_dir).select("doc_id", F.col("seg_idx").cast("long").alias("seg_idx"), "text")


@query(f"select conv_id, turn, unnest(s) as text, cast(generate_subscripts(s, 1) - 1 as bigint) as seg_idx from (select conv_id, turn, {_sentences('text')} as s from conversations where text is not null)")
def segment_conversations(spark, sf_dir):
    df = table(spark, sf_dir, "conversations").where("text is not null")
    return df.select("conv_id", "turn", F.posexplode(tx.sentences(F.col("text"))).alias("seg_idx", "text")).withColumn("seg_idx", F.col("seg_idx").cast("long"))


@query(_with(SEG) + "select lang, count(*) as n_segments, cast(sum(length(text)) as bigint) as n_chars from seg group by lang")
def segment_counts_by_lang(spark, sf_dir):
    units = segments.units_of(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return segments.segment(units).groupBy("lang").agg(F.count("*").alias("n_segments"), F.sum(F.length("text")).alias("n_chars"))


@query(_with(SEG) + "select doc_id, string_agg(text, ' ' order by seg_idx) as text from seg group by doc_id")
def rejoin_segments(spark, sf_dir):
    return segments.rejoin(doc_segments(spark, sf_dir)).select("doc_id", "text")


@query("select doc_id, cast(case when text is null or text = '' then 0 else length(text) - length(replace(text, chr(10), '')) + cast(text not like '%' || chr(10) as int) end as bigint) as n_units from documents")
def preview_units(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return segments.preview(segments.line_units(docs), docs)


@query(_with(SEG, DRAFT, FEATURES) + "select doc_id, cast(seg_idx as bigint) as seg_idx, cast(char_count as bigint) as char_count, cast(placeholder_count as bigint) as placeholder_count, cast(technical_token_count as bigint) as technical_token_count, cast(sentence_count as bigint) as sentence_count, placeholder_count / greatest(1, char_count) as placeholder_ratio from feat")
def segment_features(spark, sf_dir):
    df = routing.with_features(drafts(spark, sf_dir))
    whole = [F.col(c).cast("long").alias(c) for c in ("seg_idx", "char_count", "placeholder_count", "technical_token_count", "sentence_count")]
    return df.select("doc_id", *whole, "placeholder_ratio")


@query(_with(SEG, DRAFT, FEATURES) + "select doc_id, cast(sum(placeholder_count) as bigint) as n_routing, cast(sum(mark_count) as bigint) as n_marks from feat group by doc_id")
def placeholder_counts(spark, sf_dir):
    c = F.col("draft")
    return drafts(spark, sf_dir).groupBy("doc_id").agg(F.sum(tx.placeholder_count(c)).alias("n_routing"), F.sum(tx.mark_count(c)).alias("n_marks"))


@query(_with(SEG, DRAFT, FEATURES) + "select lang, cast(sum(technical_token_count) as bigint) as n_tokens, cast(sum(cast(technical_token_count > 0 as int)) as bigint) as n_signals from feat group by lang")
def technical_tokens(spark, sf_dir):
    units = segments.units_of(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    df = segments.segment(units).withColumn("draft", derived())
    return df.groupBy("lang").agg(F.sum(tx.technical_count(F.col("draft"))).cast("long").alias("n_tokens"), F.sum(tx.has_technical(F.col("draft")).cast("long")).alias("n_signals"))


def _route_sql(s: PostEditSettings) -> str:
    return _with(SEG, DRAFT, FEATURES, _routed(s)) + "select doc_id, cast(seg_idx as bigint) as seg_idx, mode is not null as use_llm, mode, reason from routed"


def _route(df: DataFrame, s: PostEditSettings) -> DataFrame:
    return routing.route(df, s).select("doc_id", F.col("seg_idx").cast("long").alias("seg_idx"), "decision.use_llm", "decision.mode", "decision.reason")


@query(_route_sql(PostEditSettings()))
def route_auto(spark, sf_dir):
    return _route(drafts(spark, sf_dir), PostEditSettings())


@query(_route_sql(PostEditSettings(policy="smart")))
def route_forced(spark, sf_dir):
    return _route(drafts(spark, sf_dir), PostEditSettings(policy="smart"))


@query(_route_sql(PostEditSettings(policy="off")))
def route_off(spark, sf_dir):
    return _route(drafts(spark, sf_dir), PostEditSettings(policy="off"))


@query(_route_sql(PostEditSettings(skip_high_placeholder_ratio=0.02)))
def route_low_ratio(spark, sf_dir):
    return _route(drafts(spark, sf_dir), PostEditSettings(skip_high_placeholder_ratio=0.02))


@query(_with("draft as (select doc_id, lang, 0 as seg_idx, text as draft from documents where text is not null)", FEATURES, _routed(PostEditSettings())) + "select doc_id, mode is not null as use_llm, mode, reason from routed")
def route_unsegmented(spark, sf_dir):
    return _route(doc_units(spark, sf_dir).withColumnsRenamed({"text": "draft", "unit_idx": "seg_idx"}), PostEditSettings()).drop("seg_idx")


@query(_with(SEG, DRAFT, FEATURES, _routed(PostEditSettings())) + "select lang, reason, count(*) as n from routed group by all")
def routing_reason_histogram(spark, sf_dir):
    units = segments.units_of(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return routing.reason_histogram(routing.route(segments.segment(units).withColumn("draft", derived())), "lang")


@query(_with(SEG, _glossary_sql(plain.REPLACED)) + f"select doc_id, cast(seg_idx as bigint) as seg_idx, {_swapped_sql('t', plain.REPLACED)} as text, {_count_sql(plain.REPLACED)} as n from {LAST}")
def glossary_apply(spark, sf_dir):
    df = glossary.apply(doc_segments(spark, sf_dir), TERMS)
    return df.select("doc_id", F.col("seg_idx").cast("long").alias("seg_idx"), F.col("applied").alias("text"), F.col("applied_n").cast("long").alias("n"))


@query(_with(SEG, _glossary_sql(plain.TERM)) + f"select doc_id, cast(seg_idx as bigint) as seg_idx, t as text, {_count_sql(plain.TERM)} as n from {LAST}")
def glossary_protect(spark, sf_dir):
    df = glossary.protect(doc_segments(spark, sf_dir), TERMS)
    return df.select("doc_id", F.col("seg_idx").cast("long").alias("seg_idx"), F.col("protected").alias("text"), F.col("protected_n").cast("long").alias("n"))


@query(_with(SEG, _glossary_sql(plain.TERM)) + f"select doc_id, cast(seg_idx as bigint) as seg_idx, {_swapped_sql('t', plain.TERM)} as text, {_count_sql(plain.TERM)} as n from {LAST}")
def glossary_restore(spark, sf_dir):
    """Placeholders lose their underscores first, as engines do it."""
    df = glossary.protect(doc_segments(spark, sf_dir), TERMS)
    df = df.withColumn("lost", F.regexp_replace("protected", r"__LT_GLOSSARY_TERM_(\d{4})__", "LT GLOSSARY TERM $1"))
    df = glossary.restore(df, TERMS, "lost", "protected_map")
    return df.select("doc_id", F.col("seg_idx").cast("long").alias("seg_idx"), F.col("restored").alias("text"), F.col("restored_n").cast("long").alias("n"))


@query(_with(SEG, _glossary_sql(plain.REPLACED)) + f"select s.lang, cast(sum({_count_sql(plain.REPLACED)}) as bigint) as n_replaced, cast(sum(length({_swapped_sql('t', plain.REPLACED)})) as bigint) as n_chars from {LAST} join seg s using (doc_id, seg_idx) group by s.lang")
def glossary_stats(spark, sf_dir):
    units = segments.units_of(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    df = glossary.apply(segments.segment(units), TERMS)
    return df.groupBy("lang").agg(F.sum("applied_n").cast("long").alias("n_replaced"), F.sum(F.length("applied")).cast("long").alias("n_chars"))


@query(_with(SEG) + " union all ".join(f"select '{s}' as source, '{t}' as target, cast(sum(cast(contains(text, '{t}') as int)) as bigint) as n_segments from seg" for s, t in TERMS))
def glossary_hits(spark, sf_dir):
    terms = spark.createDataFrame(list(TERMS), "source string, target string")
    return glossary.hits(doc_segments(spark, sf_dir), terms)


SPACED = "replace(replace(text, ' the ', '  the' || chr(9) || chr(9)), ', ', ',   ')"


@query(f"select doc_id, {_spaced_sql(SPACED)} as text from documents where text is not null")
def normalize_spacing(spark, sf_dir):
    c = F.replace(F.replace(F.col("text"), F.lit(" the "), F.lit("  the\t\t")), F.lit(", "), F.lit(",   "))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", tx.normalize_spacing(c).alias("text"))


@query()
def token_protect(spark, sf_dir):
    df = tokens.protect_tokens(drafts(spark, sf_dir), "draft")
    return df.select("doc_id", F.col("seg_idx").cast("long").alias("seg_idx"), "marked", F.size("marked_map").cast("long").alias("n_tokens"))


@query(_with(SEG, DRAFT) + "select doc_id, cast(seg_idx as bigint) as seg_idx, draft as text from draft")
def token_roundtrip(spark, sf_dir):
    df = tokens.protect_tokens(drafts(spark, sf_dir), "draft")
    return df.select("doc_id", F.col("seg_idx").cast("long").alias("seg_idx"), tokens.restore_tokens(F.col("marked"), F.col("marked_map")).alias("text"))


@query(_with(SEG) + "select doc_id, cast(seg_idx as bigint) as seg_idx, " + _bounded_sub("text", "X", "Y").replace("(?i)X", "of").replace("\\1Y\\3", "\\1__LT_GLOSSARY_PROTECTED_0000__\\3") + " as text from seg")
def target_protect(spark, sf_dir):
    df = tokens.protect_targets(doc_segments(spark, sf_dir), (("de", "of"),))
    return df.select("doc_id", F.col("seg_idx").cast("long").alias("seg_idx"), F.col("shielded").alias("text"))


def _chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.pack(routing.route(drafts(spark, sf_dir), CHUNKED), CHUNKED)


_PLAN = _with(SEG, DRAFT, FEATURES, _routed(CHUNKED), PACKED, recursive=True)


@query(_PLAN + "select doc_id, cast(first_segment as bigint) as first_segment, cast(n_segments as bigint) as n_segments, cast(character_count as bigint) as character_count, cast(placeholder_count as bigint) as placeholder_count, routing_mode, boundary_reason from plan")
def chunk_plan(spark, sf_dir):
    df = _chunk_plan(spark, sf_dir)
    return df.select("doc_id", F.element_at("segment_indices", 1).cast("long").alias("first_segment"), F.size("segment_indices").cast("long").alias("n_segments"), F.col("character_count").cast("long").alias("character_count"), F.col("placeholder_count").cast("long").alias("placeholder_count"), "routing_mode", "boundary_reason")


@query(_PLAN + "select coalesce(boundary_reason, 'end') as boundary_reason, count(*) as n from plan where n_segments > 1 group by all")
def chunk_boundaries(spark, sf_dir):
    return _chunk_plan(spark, sf_dir).where(F.size("segment_indices") > 1).groupBy(F.coalesce("boundary_reason", F.lit("end")).alias("boundary_reason")).agg(F.count("*").alias("n"))


_PAYLOAD = "string_agg('[SEGMENT_' || seg_idx || ']' || chr(10) || text || chr(10) || '[/SEGMENT_' || seg_idx || ']', chr(10) || chr(10) order by seg_idx)"


@query(_with(SEG) + f"select doc_id, {_PAYLOAD} as payload from seg group by doc_id")
def chunk_payload(spark, sf_dir):
    rows = F.transform(F.sort_array(F.collect_list(F.struct("seg_idx", "text"))), lambda x: x["text"])
    return doc_segments(spark, sf_dir).groupBy("doc_id").agg(chunks.payload(rows).alias("payload"))


@query(_with(SEG, "texts as (select doc_id, string_agg(text, ' | ' order by seg_idx) as text, count(*) as n from seg group by doc_id)") + "select doc_id, case doc_id % 4 when 1 then 'missing_segment' when 2 then 'malformed_markers' end as reason, case when doc_id % 4 in (0, 3) then text end as text from texts")
def chunk_parse(spark, sf_dir):
    """Payloads back to texts; some lack a block or carry text between blocks."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct("seg_idx", "text"))), lambda x: x["text"])
    df = doc_segments(spark, sf_dir).groupBy("doc_id").agg(chunks.payload(rows).alias("payload"), F.count("*").alias("n"))
    kind = F.col("doc_id") % 4
    said = F.when(kind == 1, F.replace("payload", F.lit("[/SEGMENT_0]"), F.lit(""))).when(kind == 2, F.concat("payload", F.lit("\nand more"))).otherwise(F.col("payload"))
    out = chunks.parsed(said, F.col("n"))
    return df.select("doc_id", out["reason"].alias("reason"), F.array_join(out["texts"], " | ").alias("text"))


@query(_with(SEG, DRAFT, FEATURES, _routed(PostEditSettings())) + "select doc_id, cast(seg_idx as bigint) as seg_idx, cast(greatest(24, least(256, cast(floor(char_count * case when mode = 'safe' then cast(0.55 as double) else cast(0.85 as double) end) as int) + 16)) as bigint) as budget from routed where mode is not null")
def token_budget(spark, sf_dir):
    df = routing.route(drafts(spark, sf_dir)).where("decision.use_llm")
    return df.select("doc_id", F.col("seg_idx").cast("long").alias("seg_idx"), tx.token_budget(F.col("draft"), F.col("decision.mode")).cast("long").alias("budget"))


_CANDIDATE = """case seg_idx % 6 when 0 then d when 1 then '' when 2 then d || d when 3 then replace(d, '__LT_PROTECTED_0000__', 'x') when 4 then replace(d, '__LT_GLOSSARY_PROTECTED_0001__', 'y') else replace(d, ' ', chr(10)) end"""
_IDS = "list_sort(regexp_extract_all(c, '__LT_{}_(\\d{{4}})__', 1))"


_JUDGED = (
    _with(SEG, "d as (select doc_id, seg_idx, '__LT_PROTECTED_0000__ ' || text || ' __LT_GLOSSARY_PROTECTED_0001__' as d from seg)", f"c as (select *, {_CANDIDATE} as c from d)")
    + f"""select doc_id, cast(seg_idx as bigint) as seg_idx, case when trim(d) <> '' and {_strip('c')} = '' then 'empty_output'
  when length(c) > floor(length(d) * cast(1.4 as double)) then 'length_expansion' when {_IDS.format('PROTECTED')} <> ['0000'] then 'placeholder_mismatch'
  when {_IDS.format('GLOSSARY_PROTECTED')} <> ['0001'] then 'glossary_placeholder_mismatch'
  when length(c) - length(replace(c, chr(10), '')) > length(d) - length(replace(d, chr(10), '')) + 3 then 'unexpected_reformat' end as reason from c"""
)


@query(_JUDGED)
def validate_candidates(spark, sf_dir):
    return _judged(spark, sf_dir).select("doc_id", F.col("seg_idx").cast("long").alias("seg_idx"), "reason")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = F.col("d"), F.col("seg_idx") % 6
    df = doc_segments(spark, sf_dir).withColumn("d", F.concat(F.lit("__LT_PROTECTED_0000__ "), "text", F.lit(" __LT_GLOSSARY_PROTECTED_0001__")))
    c = F.when(i == 0, d).when(i == 1, "").when(i == 2, F.concat(d, d)).when(i == 3, F.replace(d, F.lit("__LT_PROTECTED_0000__"), F.lit("x"))).when(i == 4, F.replace(d, F.lit("__LT_GLOSSARY_PROTECTED_0001__"), F.lit("y"))).otherwise(F.replace(d, F.lit(" "), F.lit("\n")))
    marks = F.array(*(F.struct(F.lit(p).alias("ph"), F.lit("z").alias("lit")) for p in ("__LT_PROTECTED_0000__", "__LT_GLOSSARY_PROTECTED_0001__")))
    return df.withColumn("c", c).select("doc_id", "seg_idx", tokens.failure(d, d, F.col("c"), marks, 1.4).alias("reason"))


_EXPECTED = ("__LT_PROTECTED_0000__", "__LT_GLOSSARY_PROTECTED_0001__", "__LT_PROTECTED_0002__")
_DIFF_DRAFT = f"d as (select doc_id, seg_idx, '{_EXPECTED[0]} ' || text || ' {_EXPECTED[1]} {_EXPECTED[2]}' as d from seg)"
_DIFF_CANDIDATE = f"c as (select doc_id, seg_idx, case seg_idx % 4 when 0 then d when 1 then replace(d, '{_EXPECTED[0]}', 'x') when 2 then replace(replace(d, '{_EXPECTED[1]}', ''), '{_EXPECTED[2]}', '__LT_PROTECTED_0009__') else d || ' __LT_GLOSSARY_PROTECTED_0007__ __LT_PROTECTED_0005__' end as c from d)"
_FOUND = "regexp_extract_all(c, '__LT_(?:GLOSSARY_)?PROTECTED_\\d{4}__')"


@query(
    _with(SEG, _DIFF_DRAFT, _DIFF_CANDIDATE)
    + f"select doc_id, cast(seg_idx as bigint) as seg_idx, array_to_string(list_filter({list(_EXPECTED)}, lambda x: not list_contains({_FOUND}, x)), ',') as missing, array_to_string(list_filter({_FOUND}, lambda x: not list_contains({list(_EXPECTED)}, x)), ',') as extra from c"
)
def placeholder_diff(spark, sf_dir):
    first, second, third = _EXPECTED
    d, i = F.col("d"), F.col("seg_idx") % 4
    df = doc_segments(spark, sf_dir).withColumn("d", F.concat(F.lit(first + " "), "text", F.lit(f" {second} {third}")))
    swapped = F.replace(F.replace(d, F.lit(second), F.lit("")), F.lit(third), F.lit("__LT_PROTECTED_0009__"))
    c = F.when(i == 0, d).when(i == 1, F.replace(d, F.lit(first), F.lit("x"))).when(i == 2, swapped).otherwise(F.concat(d, F.lit(" __LT_GLOSSARY_PROTECTED_0007__ __LT_PROTECTED_0005__")))
    out = tokens.placeholder_diff(c, F.array(*(F.struct(F.lit(p).alias("ph"), F.lit("z").alias("lit")) for p in _EXPECTED)))
    return df.select("doc_id", F.col("seg_idx").cast("long").alias("seg_idx"), F.array_join(out["missing"], ",").alias("missing"), F.array_join(out["extra"], ",").alias("extra"))


@query()
def reinject_placeholders(spark, sf_dir):
    """Engines that gave back the literals: all placeholders return to their places."""
    df = tokens.protect_tokens(drafts(spark, sf_dir), "draft")
    out = postedit.reinject_placeholders(df.select("doc_id", "seg_idx", "draft", "marked", "marked_map"), "draft", "marked_map")
    return out.select("doc_id", F.col("seg_idx").cast("long").alias("seg_idx"), "reinjected", (F.col("reinjected") == F.col("marked")).alias("same"))


@query(_with(SEG) + f"select doc_id, string_agg({_spaced_sql(chr(40) + 'text || ' + chr(39) + ' [en]' + chr(39) + chr(41))}, ' ' order by seg_idx) as text from seg group by doc_id")
def translate_tagged(spark, sf_dir):
    """Blank units stay as they are; there are none with text in these tables."""
    return translated_text(doc_units(spark, sf_dir), RunConfig(), engines.tag()).select("doc_id", "text")


_FIRST = f"first as (select doc_id, seg_idx, {_swapped_sql('t', plain.TERM)} || ' [en]' as t, {_count_sql(plain.TERM)} as n from {LAST})"
_SECOND = _glossary_sql(plain.REPLACED, "select doc_id, seg_idx, t from first", "h")
_FINAL = f"last as (select doc_id, seg_idx, {_spaced_sql(_swapped_sql('t', plain.REPLACED))} as t, {_count_sql(plain.REPLACED)} as n from h{N})"


@query(_with(SEG, _glossary_sql(plain.TERM), _FIRST, _SECOND, _FINAL) + "select doc_id, string_agg(last.t, ' ' order by seg_idx) as text, cast(sum(2 * first.n + last.n) as bigint) as glossary_replacements from last join first using (doc_id, seg_idx) group by doc_id")
def translate_with_glossary(spark, sf_dir):
    """Terms are counted when they are marked, when they come back, and once more in the final text."""
    return translated(doc_units(spark, sf_dir), RunConfig(glossary=TERMS), engines.tag()).select("doc_id", "text", "glossary_replacements")


_RAW = "draft as (select doc_id, lang, seg_idx, text as draft from seg)"


def _hybrid(spark: SparkSession, sf_dir: str, editor: str, settings: PostEditSettings, terms: plain.Entries = ()) -> DataFrame:
    config = RunConfig(engine=EngineMode.HYBRID, settings=settings, glossary=terms)
    return translated(doc_units(spark, sf_dir), config, engines.identity(), engines.POST_EDITORS[editor])


_CALLS = ["llm_calls", "llm_skipped", "fallback_count", "chunk_fallbacks", "llm_chunks_built", "llm_calls_saved_by_chunking", "glossary_replacements"]


@query()
def hybrid_echo(spark, sf_dir):
    return _hybrid(spark, sf_dir, "echo", CHUNKED, TERMS).select("doc_id", "text", *_CALLS)


@query(
    _with(SEG, _RAW, FEATURES, _routed(CHUNKED), PACKED, "built as (select doc_id, count(*) as n from plan where n_segments > 1 group by doc_id)", recursive=True)
    + f"""select doc_id, string_agg({_spaced_sql('draft')}, ' ' order by seg_idx) as text, count(mode) + coalesce(min(n), 0) as llm_calls, count(*) - count(mode) as llm_skipped, cast(0 as bigint) as fallback_count,
  coalesce(min(n), 0) as chunk_fallbacks, coalesce(min(n), 0) as llm_chunks_built, cast(0 as bigint) as llm_calls_saved_by_chunking, cast(0 as bigint) as glossary_replacements
from routed left join built using (doc_id) group by doc_id"""
)
def hybrid_broken_markers(spark, sf_dir):
    return _hybrid(spark, sf_dir, "broken_markers", CHUNKED).select("doc_id", "text", *_CALLS)


@query(_with(SEG, _RAW, FEATURES, _routed(PostEditSettings())) + f"select doc_id, string_agg({_spaced_sql('draft')}, ' ' order by seg_idx) as text, count(mode) as llm_calls, count(*) - count(mode) as llm_skipped, count(mode) as fallback_count, count(mode) as n_exceptions from routed group by doc_id")
def hybrid_failing_fallback(spark, sf_dir):
    n = F.coalesce(F.try_element_at("validation_failures", F.lit("llm_exception")), F.lit(0)).cast("long")
    return _hybrid(spark, sf_dir, "fail", PostEditSettings()).select("doc_id", "text", "llm_calls", "llm_skipped", "fallback_count", n.alias("n_exceptions"))


_LINE_SEG = f"""lines as (
  select doc_id, unnest(l) as text, generate_subscripts(l, 1) - 1 as unit_idx
  from (select doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) as l from documents where text is not null and text <> '')),
seg as (select doc_id, unit_idx, unnest(s) as text, generate_subscripts(s, 1) - 1 as seg_idx from (select doc_id, unit_idx, {_sentences('text')} as s from lines)),
draft as (select doc_id, null as lang, unit_idx, seg_idx, text as draft from seg)"""
_REASONS = ("short_plain_segment", "default_safe", "long_natural_language_segment", "multi_sentence_prose")
_REPORT_SQL = "count(*) as segment_count, count(*) as translated_count, count(*) filter (mode = 'safe') as llm_safe_segments, count(*) filter (mode = 'smart') as llm_smart_segments, " + ", ".join(f"count(*) filter (reason = '{r}') as n_{r}" for r in _REASONS)
_LINE_REPORT = _with(_LINE_SEG, FEATURES, _routed(PostEditSettings()))


def _line_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = segments.line_units(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return translated(units, RunConfig(), engines.identity())


def _flat(df: DataFrame, *keys: str) -> DataFrame:
    of = lambda r: F.coalesce(F.try_element_at("routing_reasons", F.lit(r)), F.lit(0)).cast("long").alias(f"n_{r}")
    return df.select(*keys, "segment_count", "translated_count", "llm_safe_segments", "llm_smart_segments", *map(of, _REASONS))


@query(_LINE_REPORT + f"select doc_id, cast(unit_idx as bigint) as unit_idx, {_REPORT_SQL} from routed group by doc_id, unit_idx")
def unit_report(spark, sf_dir):
    return _flat(_line_reports(spark, sf_dir), "doc_id", "unit_idx").withColumn("unit_idx", F.col("unit_idx").cast("long"))


@query(_LINE_REPORT + f"select doc_id, {_REPORT_SQL} from routed group by doc_id")
def doc_report(spark, sf_dir):
    return _flat(reports.merge_reports(_line_reports(spark, sf_dir)), "doc_id")


@query(
    _LINE_REPORT
    + "select (select count(*) from (select distinct doc_id from routed)) as reports, count(*) as segments, cast(0 as double) as llm_skip_rate, count(*) filter (mode = 'safe') / count(*) as safe_share, count(*) filter (mode = 'smart') / count(*) as smart_share, cast(0 as bigint) as chunk_fallbacks, cast(0 as bigint) as segment_fallbacks, cast(0 as double) as avg_chunk_size, cast(0 as bigint) as llm_calls_saved_by_chunking from routed"
)
def report_summary(spark, sf_dir):
    return reports.summarize(reports.merge_reports(_line_reports(spark, sf_dir)), rounded=False)


@query(f"select reason, count(*) as n, row_number() over (order by count(*) desc, reason) as place from ({_JUDGED}) where reason is not null group by reason")
def failure_ranking_mixed(spark, sf_dir):
    """Several reasons, some of them equally frequent, from one map a document."""
    failed = _judged(spark, sf_dir).where("reason is not null").groupBy("doc_id").agg(reports.histogram(F.collect_list("reason")).alias("validation_failures"))
    return reports.failure_ranking(failed).withColumn("place", F.col("place").cast("long"))


@query(_with(SEG, _RAW, FEATURES, _routed(PostEditSettings())) + "select 'llm_exception' as reason, count(mode) as n, cast(1 as bigint) as place from routed having count(mode) > 0")
def failure_ranking(spark, sf_dir):
    return reports.failure_ranking(_hybrid(spark, sf_dir, "fail", PostEditSettings())).withColumn("place", F.col("place").cast("long"))


_ENTRY = """'{"segment_index":' || seg_idx || ',"mode":"' || coalesce(mode, 'skip') || '","reason":"' || reason || '","char_count":' || char_count || ',"placeholder_count":' || mark_count || '}'"""


@query(
    _LINE_REPORT.rstrip() + f""",
counted as (select doc_id, reason, count(*) as n from routed group by all),
reasons as (select doc_id, string_agg('"' || reason || '":' || n, ',' order by reason) as said from counted group by doc_id),
traces as (select doc_id, count(*) as n, string_agg({_ENTRY}, ',' order by unit_idx, seg_idx) as said from routed group by doc_id)
select t.doc_id, '{{"segment_count":' || t.n || ',"routing_reasons":{{' || r.said || '}},"routing_trace":[' || t.said || ']}}' as report from traces t join reasons r on r.doc_id = t.doc_id"""
)
def report_json(spark, sf_dir):
    df = reports.merge_reports(_line_reports(spark, sf_dir))
    return df.select("doc_id", F.to_json(F.struct("segment_count", "routing_reasons", "routing_trace")).alias("report"))


@query("select doc_id, case when regexp_extract(o, '^\\s*') = '' and regexp_extract(o, '\\s*$') = '' then t else regexp_extract(o, '^\\s*') || regexp_replace(t, '^\\s+|\\s+$', '', 'g') || regexp_extract(o, '(\\s*)$', 1) end as text from (select doc_id, case when doc_id % 3 = 0 then chr(10) || '  ' || text || ' ' else text end as o, ' ' || upper(lang) || chr(9) as t from documents where text is not null)")
def edge_whitespace(spark, sf_dir):
    df = table(spark, sf_dir, "documents").where("text is not null")
    original = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\n  "), "text", F.lit(" "))).otherwise(F.col("text"))
    translated = F.concat(F.lit(" "), F.upper("lang"), F.lit("\t"))
    return df.select("doc_id", tx.edge_preserved(original, translated).alias("text"))


@query(f"select doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_strip('x')}), lambda x: x <> ''), chr(10) || chr(10)) || chr(10) as text from documents where text is not null")
def sidecar_text(spark, sf_dir):
    units = segments.line_units(table(spark, sf_dir, "documents").select("doc_id", "text"))
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id")
    return sinks.sidecar(units, docs)


_LINES = _with(_LINE_SEG.split("),\nseg as")[0] + ")", "said as (select doc_id, unit_idx, case when unit_idx % 3 = 0 then '> ' || text else text end as text from lines)")


def _partly_translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = segments.line_units(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return sinks.with_fallback(units, units.where("unit_idx % 3 = 0").withColumn("text", F.concat(F.lit("> "), "text")))


@query(_LINES + "select doc_id, string_agg(text, chr(10) order by unit_idx) as text from said group by doc_id")
def text_sink(spark, sf_dir):
    """Units without a translation keep their text."""
    return sinks.text_file(_partly_translated(spark, sf_dir))


@query(_LINES + "select doc_id, coalesce(string_agg(said.text, chr(10) order by unit_idx), '') || chr(10) as text from documents left join said using (doc_id) where documents.text is not null group by doc_id")
def markdown_sink(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id")
    return sinks.markdown_file(_partly_translated(spark, sf_dir), docs)


@query("select doc_id, cast(length(regexp_replace(text, '[^\\pL\\pN]', '', 'g')) as bigint) as n_chars, length(regexp_replace(text, '[^\\pL\\pN]', '', 'g')) >= 20 as meaningful from documents where text is not null")
def meaningful_chars(spark, sf_dir):
    n = tx.alphanumeric_count(F.col("text")).cast("long")
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", n.alias("n_chars"), (n >= 20).alias("meaningful"))


@query(f"select doc_id, {_strip('array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, ' + chr(39) + chr(92) + 's+$' + chr(39) + ', ' + chr(39) * 2 + ')), lambda x: x <> ' + chr(39) * 2 + '), chr(10))')} as text from documents where text is not null")
def page_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", tx.page_normalized(F.col("text")).alias("text"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing_reason_histogram(spark, sf_dir)


from . import catalog_files, catalog_plans  # noqa: E402, F401 - they register their queries
