"""The registered query of each corpus operator and its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import chat, decontamination, fingerprints, html_extract, line_dedup, near_dedup, packing, quality, sharding, toxicity
from quarry.llm.shared import staged, table
from quarry.llm.simhash_sql import simhash_sql

QUERIES, ORACLE_SQL = {}, {}

SHARDS = 24


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose turns hold control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i,
                    r in enumerate(("user", "assistant"))
                ]
            )
        ).alias("x"),
    ).select("conv_id", "x.*")
    out = chat.format_chat(rows.unionByName(probe))
    back = out.withColumn("turns", chat.parsed(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments")))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES["op7_chat_format"] = op7_chat_format
#: A turn adds its escaped text and 11 characters of `<|im_turn|>`, or as the first of a run its role and 32 of the other three markers.
ORACLE_SQL["op7_chat_format"] = r"""
with rows_ as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked as (
  select *, regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g') as safe,
    regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g') as safe_role,
    lag(role) over (partition by conv_id order by turn, role, text) as before
  from rows_
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(safe) + case when before is null or before <> role then length(safe_role) + 32 else 11 end) as bigint) as formatted_chars
from marked group by conv_id
"""


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of equal row counts along a Hilbert curve over language, source and size."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    # the checksum travels in the place of the size's row: both are read off the text at the scan
    meta = docs.select(
        F.struct(F.col("doc_id"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("crc")).alias("row"),
        "lang", "source", size.alias("size"), sharding.hashed(F.coalesce(F.col("text"), F.lit(""))).alias("same"),
    )
    out = sharding.shard(
        meta,
        {
            "lang_cell": sharding.quantised_name(F.col("lang"), 8),
            "source_cell": sharding.quantised_name(F.col("source"), 8),
            "size_cell": sharding.quantised_log(F.col("size"), 8),
        },
        SHARDS, F.col("size"), key="row", group=F.col("same"),
    )
    return out.select(
        F.col("row.doc_id").alias("doc_id"), "size", F.col("row.crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve", "lang_cell", "source_cell", "size_cell",
    )


QUERIES["op10_sharding"] = op10_sharding
#: CRC-32 byte by byte, of which _CRC is what each bit of the lowest byte adds (fixed values); the curve by Skilling's steps over the
#: distinct cells, three axes a level from the highest bit down.
_CRC = (0x77073096, 0xEE0E612C, 0x076DC419, 0x0EDB8832, 0x1DB71064, 0x3B6E20C8, 0x76DC4190, 0xEDB88320)
_CRC_STEP = "c >> 8"
for _k, _c in enumerate(_CRC):
    _CRC_STEP = f"xor({_CRC_STEP}, ((xor(c, b) >> {_k}) & 1) * {_c})"
_ABOVE = "y2 >> 1"
for _k in range(2, 8):
    _ABOVE = f"xor({_ABOVE}, y2 >> {_k})"
ORACLE_SQL["op10_sharding"] = f"""
with recursive bytes_ as (
  select doc_id, [cast(4294967295 as bigint)] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: cast('0x' || h as bigint)) as l
  from documents
), crcs as (select doc_id, xor(list_reduce(l, lambda c, b: {_CRC_STEP}), 4294967295) as text_crc32 from bytes_),
meta as (
  select doc_id, text_crc32, octet_length(encode(coalesce(text, ''))) + 8 as size, cast('0x' || md5(coalesce(text, ''))[1:15] as bigint) as same,
    case when lang is null then 0 else cast('0x' || md5(lang)[1:15] as bigint) % 256 end as lang_cell,
    case when source is null then 0 else cast('0x' || md5(source)[1:15] as bigint) % 256 end as source_cell
  from documents join crcs using (doc_id)
), celled as (select *, least(cast(floor(ln(size + 1) / ln(2) * 255 / 42) as bigint), 255) as size_cell from meta),
least_ as (
  select same, lang_cell, source_cell, size_cell from celled
  qualify row_number() over (partition by same order by lang_cell, source_cell, size_cell) = 1
), walk as (
  select distinct lang_cell, source_cell, size_cell, lang_cell as x0, source_cell as x1, size_cell as x2, 0 as step from least_
  union all
  select lang_cell, source_cell, size_cell,
    case when is_set then xor(x0, low) else xor(x0, swap) end, case when axis = 1 and not is_set then xor(x1, swap) else x1 end,
    case when axis = 2 and not is_set then xor(x2, swap) else x2 end, step + 1
  from (
    select *, xor(x0, x) & low as swap, (x >> level) & 1 = 1 as is_set
    from (
      select *, 7 - step // 3 as level, step % 3 as axis, (cast(1 as bigint) << (7 - step // 3)) - 1 as low,
        case step % 3 when 0 then x0 when 1 then x1 else x2 end as x
      from walk where step < 21
    )
  )
), gray as (select *, x0 as y0, xor(x1, x0) as y1, xor(x2, xor(x1, x0)) as y2 from walk where step = 21),
flipped as (select *, {_ABOVE} as t from gray),
curves as (
  select lang_cell, source_cell, size_cell,
    cast(sum((((xor(y0, t) >> k) & 1) * 4 + ((xor(y1, t) >> k) & 1) * 2 + ((xor(y2, t) >> k) & 1)) << (3 * k)) as bigint) as curve
  from flipped, (select cast(unnest(range(8)) as integer) as k) group by lang_cell, source_cell, size_cell
), placed as (
  select doc_id, size, text_crc32, curve, lang_cell, source_cell, size_cell,
    row_number() over (order by curve, same, doc_id, text_crc32, size) - 1 as place, count(*) over () as n
  from (select doc_id, size, text_crc32, same from celled) c join least_ l using (same) join curves using (lang_cell, source_cell, size_cell)
)
select doc_id, size, text_crc32, 'rows' as law, cast(place * {SHARDS} // n as integer) as shard,
  row_number() over (partition by place * {SHARDS} // n order by place) - 1 as slot, cast(null as integer) as grown_shard, curve, lang_cell, source_cell, size_cell
from placed
"""


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by 64-bit SimHash of 3-word shingles, linked at 3 or fewer differing bits."""
    out = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=3, bits=64, radius=3)
    return out.select("doc_id", near_dedup.hex_of(["w0"]).alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES["op3_simhash_near_dedup"] = op3_simhash_near_dedup
ORACLE_SQL["op3_simhash_near_dedup"] = simhash_sql(size=3, radius=3)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and their edited texts by 128-bit SimHash; every fiftieth document searches all others within 3 bits."""
    out = staged(fingerprints.edit_robustness(table(spark, sf_dir, "documents").select("doc_id", "text")), "compared")
    prints = out.groupBy("f0", "f1").agg(F.count("*").alias("__n"))
    hits = fingerprints.search(out.filter("doc_id % 50 = 0"), prints, radius=3)
    # itself and its copies count, as they lie within any radius
    near = hits.join(prints, ["f0", "f1"]).groupBy(
        F.col("q0").alias("f0"), F.col("q1").alias("f1")
    ).agg(F.sum("__n").alias("__near"))
    both = out.join(staged(near, "near"), ["f0", "f1"], "left")
    return both.select(
        "doc_id", "n_chars", "edited_sha256", near_dedup.hex_of(["f0", "f1"]).alias("fingerprint"), near_dedup.hex_of(["e0", "e1"]).alias("edited_fingerprint"),
        "near_edited", "near_next", F.when(F.col("doc_id") % 50 == 0, F.col("__near")).alias("found_within_3"),
    )


QUERIES["op5_fingerprints"] = op5_fingerprints


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, tokenised and packed into sequences of 4096 tokens."""
    import public_tokenizers

    out = packing.pack(
        table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), end_id=2
    )
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES["op8_packing"] = op8_packing


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the benchmark items that each holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.leaks(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    item = F.struct("item_id", "coverage", "verbatim", "first_word", "last_word")
    held = staged(found.groupBy("doc_id").agg(F.sort_array(F.collect_list(item)).alias("items")), "leaks")
    return docs.select("doc_id").join(held, "doc_id", "left").select(
        "doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce(
            F.transform("items", lambda x: x["item_id"]), F.array().cast("array<bigint>")
        ).alias("item_ids"), "items"
    )


QUERIES["op4_decontamination"] = op4_decontamination


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the runs of lines, of 50 words or more, that stand in an earlier place."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        "text",
        F.aggregate("__removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["begin"] + 1).alias("n_removed"),
        F.array_join(F.transform("__removed", lambda x: F.concat_ws("-", x["begin"], x["end"])), " ").alias("removed"),
    )


QUERIES["op6_line_dedup"] = op6_line_dedup
#: Windows by their whole content: no hash, no fingerprint and no join of positions.
ORACLE_SQL["op6_line_dedup"] = r"""
with split_ as (select doc_id, string_split(text, chr(10)) as l from documents where text is not null),
lines as (select doc_id, unnest(l) as line, generate_subscripts(l, 1) - 1 as i from split_),
counted as (select *, len(regexp_extract_all(line, '[^ \t\r\f\v]+')) as w from lines),
held as (select * from (select *, sum(w) over (partition by doc_id order by i) as upto from counted) where w > 0),
windows as (
  select a.doc_id, a.i as b, min(z.i) as e from held a join held z on a.doc_id = z.doc_id and z.i >= a.i and z.upto - a.upto + a.w >= 50 group by a.doc_id, a.i
  union
  select z.doc_id, max(a.i) as b, z.i as e from held a join held z on a.doc_id = z.doc_id and z.i >= a.i and z.upto - a.upto + a.w >= 50 group by z.doc_id, z.i
),
placed as (
  select doc_id, b, e, first_value(doc_id) over f as fd, first_value(b) over f as fb, first_value(e) over f as fe
  from (select w.*, array_to_string(l[b + 1:e + 1], chr(10)) as content from windows w join split_ using (doc_id))
  window f as (partition by content order by doc_id, b, e)
),
gone as (select doc_id, case when fd = doc_id then greatest(b, fe + 1) else b end as b, e from placed where fd <> doc_id or fb <> b),
marked as (select doc_id, i, line, exists (select 1 from gone g where g.doc_id = lines.doc_id and i between g.b and g.e) as cut from lines),
runs as (
  select doc_id, min(i) as b, max(i) as e from (select doc_id, i, i - row_number() over (partition by doc_id order by i) as run from marked where cut) group by doc_id, run
),
spans as (select doc_id, string_agg(b || '-' || e, ' ' order by b) as removed from runs group by doc_id),
kept as (
  select doc_id, coalesce(string_agg(line, chr(10) order by i) filter (where not cut), '') as text, count(*) filter (where cut) as n_removed from marked group by doc_id
)
select d.doc_id, k.text, coalesce(n_removed, 0) as n_removed, coalesce(removed, '') as removed
from documents d left join kept k using (doc_id) left join spans using (doc_id)
"""


def fold(key: str, parts: int):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by their nearest labelled examples; fold 0 of 5 is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0)
    out = toxicity.score(docs, toxicity.fit(docs, labels))
    return out.select(
        "doc_id",
        (fold("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "neighbours",
        "cosines",
    )


QUERIES["op1_toxicity"] = op1_toxicity


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored for quality by attention over their passages; fold 2 of 4 is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id", 4) != 2)
    out = quality.score(docs, quality.fit(docs, labels))
    return out.select(
        "doc_id",
        (fold("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        "n_passages",
        "top_passage",
        "top_attention",
    )


QUERIES["op2_quality"] = op2_quality


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    out = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES["op9_html_extract"] = op9_html_extract
#: The tables' pages have one article each, which holds blocks, inline elements and a few named references only.
ORACLE_SQL["op9_html_extract"] = r"""
with body as (
  select page_id, regexp_extract(regexp_replace(html, '(?s)<(script|style)>.*?</(script|style)>', '', 'g'), '(?s)<article>(.*?)</article>', 1) as inner_html
  from pages
), parts as (select page_id, regexp_split_to_array(inner_html, '</?(p|h[1-6]|ul|ol|li|div|table|tr|td|th|blockquote|pre)( [^>]*)?>') as l from body),
blocks as (select page_id, generate_subscripts(l, 1) as i, unnest(l) as part from parts),
plain as (select page_id, i, regexp_replace(regexp_replace(part, '<br */?>', ' ', 'g'), '<[^>]+>', '', 'g') as part from blocks),
read as (
  select page_id, i, trim(regexp_replace(
    regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(part, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#39;', chr(39)), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) as part
  from plain
), joined as (select page_id, string_agg(part, chr(10) order by i) filter (where part <> '') as text from read group by page_id)
select p.page_id, p.url, coalesce(text, '') as text, cast(length(coalesce(text, '')) as bigint) as n_chars from pages p left join joined using (page_id)
"""
