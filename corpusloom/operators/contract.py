"""Checks of generated answers against the texts they cite.

An answer is JSON {contract_version, teacher, blocks}. What an answer can be judged
by alone (grounding, order, diversity) is read from its own row with array functions;
only the look-ups of sections, sources and translations are joins, one each. An
answer that fails the schema gets that violation and no other.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from corpusloom.functions.normalize import normal, normalized, snapped_quote

RANGE = "start: bigint, end: bigint"
ITEM = f"{RANGE}, translation: string, source_id: bigint, title: string, author: string, note: string"
ATTRIBUTION = "author: string, work: string, slug: string, year: int, tradition: string, origin: string"
ANSWER = (
    "contract_version string, teacher string, blocks array<struct<type: string, text: string, section_id: bigint, "
    f"attribution: struct<{ATTRIBUTION}>, quote: string, summary: string, anchors: array<struct<{RANGE}>>, items: array<struct<{ITEM}>>>>"
)
# Phrases an answer must not use in its own voice, by rule.
SCREENS = [
    ("I3", r"\byou (should|must|need to|ought to|have to)\b"),
    ("I3", r"\bgod (is telling you|wants you to|is calling you to|commands you)\b"),
    ("I3", r"\bthis means you\b"),
    ("I2", r"\bthe (correct|right|better|stronger|best) (view|reading|interpretation|position)\b"),
    ("I2", r"\b(is|are) (simply |plainly |clearly )?(wrong|mistaken|in error)\b"),
    ("I1", r"\bthe bible (clearly |plainly )?(teaches|says|commands|forbids)\b"),
    ("I1", r"\bscripture (clearly |plainly )?(teaches|commands|forbids)\b"),
    ("I1", r"\bthe truth is\b"),
    ("I5", r"\b(yes|no), (it|that|this) (is|is not|isn't) (a )?sin\b"),
    ("I5", r"\b(it|this|that) (is|is not|isn't) (a )?sin\b"),
]
# What stands for a tradition that is not known.
NO_TRADITION = ("unassigned", "unknown", "")


@F.pandas_udf(ArrayType(StringType()))
def _traditions(names: pd.Series) -> pd.Series:
    """The different traditions of each list, in comparable form."""
    return names.map(lambda some: sorted({normal(x or "") for x in some} - set(NO_TRADITION)) if some is not None else [])


def screen_hits(text: Column) -> Column:
    """array<struct<check, span>>: each rule's phrases in a text, the same phrase once a rule whatever its case."""

    def of(rule: str, pattern: str) -> Column:
        spans = F.regexp_extract_all(text, F.lit("(?i)" + pattern), 0)
        once = F.filter(spans, lambda s, i: F.array_position(F.transform(spans, F.lower), F.lower(s)) == i + 1)
        return F.transform(once, lambda s: F.struct(F.lit(f"screen:{rule}").alias("check"), s.alias("span")))

    return F.when(text.isNotNull(), F.flatten(F.array(*[of(*s) for s in SCREENS]))).otherwise(F.array().cast("array<struct<check: string, span: string>>"))


def _whole(block: Column) -> Column:
    """Whether a block has what its type requires."""
    kind, a = block["type"], block["attribution"]
    present = lambda *cs: reduce(lambda x, y: x & y, [c.isNotNull() for c in cs])
    each = lambda *names: F.coalesce(F.forall(block["items"], lambda i: present(*[i[n] for n in names])), F.lit(False))
    anchors = F.coalesce(F.forall(block["anchors"], lambda r: present(r["start"], r["end"])), F.lit(True))
    voice = present(block["section_id"], a["author"], a["work"], a["tradition"], block["quote"]) & anchors & F.coalesce(a["origin"].isin("corpus", "user_library"), F.lit(False))
    return (
        F.when(kind.isin("framing", "prayer_prompt"), block["text"].isNotNull()).when(kind == "voice", voice)
        .when(kind == "passages", each("start", "end", "translation")).when(kind == "reading", each("source_id", "title", "author")).otherwise(False)
    )


def violations(
    answers: DataFrame, sections: DataFrame, sources: DataFrame, translations: DataFrame, missing: DataFrame, canon: dict[int, int], min_voices: int = 3, min_traditions: int = 2,
) -> DataFrame:
    """(response_id, block, check, span); block is null for findings on the whole answer.

    answers: response_id, body (JSON), n_sections and traditions that retrieval
    offered. sections: section_id, origin, body, heading, author, title, tradition,
    verse_start, verse_end (null: not tied to verses). sources: source_id, author.
    translations: slug, usable. missing: translation, verse_id that it lacks. canon:
    chapters of each book, at most 66 entries.
    """
    chapters = F.create_map(*[F.lit(x) for pair in canon.items() for x in pair])

    def valid(v: Column) -> Column:
        chapter = F.floor(v / 1000) % 1000
        return F.coalesce((v > 0) & (chapter >= 1) & (chapter <= F.try_element_at(chapters, F.floor(v / 1_000_000).cast("int"))) & (v % 1000 >= 1), F.lit(False))

    parsed = answers.withColumn("a", F.from_json("body", ANSWER))
    blocks = F.col("a.blocks")
    sound = F.coalesce(F.col("a.contract_version").isin("1.0", "1.1") & F.col("a.teacher").isNotNull() & F.forall(blocks, _whole), F.lit(False))
    finding = lambda when, check, span=None: F.when(when, F.struct(F.lit(check).alias("check"), (F.lit(None) if span is None else span).cast("string").alias("span")))
    found = lambda *some: F.inline(F.filter(F.array(*some), lambda x: x.isNotNull()))
    out = [parsed.where(~sound).select("response_id", F.lit(None).cast("int").alias("block"), F.lit("schema").alias("check"), F.lit(None).cast("string").alias("span"))]

    grounding = F.flatten(F.transform(F.filter(blocks, lambda b: (b["type"] == "voice") & (b["attribution"]["origin"] == "corpus")), lambda b: F.coalesce(b["anchors"], F.array().cast(f"array<struct<{RANGE}>>"))))
    good = parsed.where(sound).withColumn("grounding", grounding)
    block = good.select("response_id", "grounding", F.posexplode("a.blocks").alias("block", "b"))

    voice = block.where("b.type = 'voice'").select("response_id", "block", "b.*").withColumn("origin", F.col("attribution.origin"))
    s = sections.select("section_id", "origin", F.struct("body", "heading", "author", "title", "tradition", "verse_start", "verse_end").alias("s"))
    cited = voice.join(s, ["section_id", "origin"], "left")
    same = lambda a, b: normalized(a) == normalized(b)
    quote = normalized("quote")
    verbatim = (F.length(quote) > 0) & F.contains(normalized(F.col("s.body")), quote)
    known = cited.where(F.col("s").isNotNull()).select(
        "*", verbatim.alias("verbatim"), same(F.col("attribution.author"), F.col("s.author")).alias("author_ok"), same(F.col("attribution.work"), F.col("s.title")).alias("title_ok"),
        same(F.col("attribution.work"), F.col("s.heading")).alias("heading_ok"), same(F.col("attribution.tradition"), F.col("s.tradition")).alias("tradition_ok"),
    )
    no = lambda c: ~F.coalesce(c, F.lit(False))
    out.append(cited.where(F.col("s").isNull()).select("response_id", "block", F.lit("section_resolves").alias("check"), F.lit(None).cast("string").alias("span")))
    out.append(known.select("response_id", "block", found(
        finding(no(F.col("verbatim")), "quote_verbatim", F.col("quote")), finding(no(F.col("author_ok")), "attribution_author"),
        finding(no(F.col("title_ok")) & no(F.col("heading_ok")), "attribution_work"), finding(no(F.col("tradition_ok")), "attribution_tradition"),
    )))
    anchor = cited.where(F.col("s").isNotNull()).select("response_id", "block", F.col("s.verse_start").alias("from"), F.col("s.verse_end").alias("to"), F.inline("anchors"))
    start, end = F.col("start"), F.col("end")
    on_base = (start <= F.col("to")) & (F.col("from") <= end) & (F.floor(start / 1000) >= F.floor(F.col("from") / 1000)) & (F.floor(end / 1000) <= F.floor(F.col("to") / 1000))
    wrong = F.when(~(valid(start) & valid(end)), "anchor_valid").when(start > end, "anchor_order").when(~on_base, "anchor_offbase")
    out.append(anchor.select("response_id", "block", wrong.alias("check"), F.concat_ws("-", "start", "end").alias("span")).where("check is not null"))

    item = block.where("b.type = 'passages'").select("response_id", "block", "grounding", F.inline("b.items")).select("response_id", "block", "grounding", "start", "end", "translation")
    usable = translations.where("usable").select(F.col("slug").alias("translation"), F.lit(True).alias("usable")).distinct()
    lacks = missing.select("translation", "verse_id").distinct()
    shown = item.join(usable, "translation", "left")
    for side in ("start", "end"):
        shown = shown.join(lacks.select("translation", F.col("verse_id").alias(side), F.lit(True).alias(f"no_{side}")), ["translation", side], "left")
    legal, span = valid(start) & valid(end), F.concat_ws("-", "start", "end")
    held = F.exists("grounding", lambda g: (g["start"] <= start) & (end <= g["end"]))
    out.append(shown.select("response_id", "block", found(
        finding(~legal, "passage_valid", span), finding(legal & (start > end), "passage_order", span),
        finding(legal & F.col("usable").isNull(), "translation_licensed", F.col("translation")),
        finding(legal & F.col("usable").isNotNull() & (F.col("no_start").isNotNull() | F.col("no_end").isNotNull()), "passage_exists", span),
        finding(legal & (start <= end) & ~held, "passages_grounded", span),
    )))

    read = block.where("b.type = 'reading'").select("response_id", "block", F.inline("b.items")).select("response_id", "block", "source_id", "author", "title", "note")
    listed = read.select("response_id", "block", "source_id", "author").join(sources.select("source_id", F.col("author").alias("by"), F.lit(True).alias("known")), "source_id", "left")
    listed = listed.withColumn("by_ok", same(F.col("author"), F.col("by")))
    out.append(listed.select("response_id", "block", found(finding(F.col("known").isNull(), "reading_resolves"), finding(F.col("known").isNotNull() & no(F.col("by_ok")), "reading_attribution"))))

    own = F.when(F.col("b.type").isin("framing", "prayer_prompt"), F.array("b.text")).when(F.col("b.type") == "voice", F.array("b.summary"))
    own = own.when(F.col("b.type") == "reading", F.flatten(F.transform("b.items", lambda i: F.array(i["title"], i["note"]))))
    spoken = block.select("response_id", "block", F.explode(own).alias("said")).where("said is not null")
    out.append(spoken.select("response_id", "block", F.inline(screen_hits(F.col("said")))))

    corpus = F.filter(blocks, lambda b: (b["type"] == "voice") & (b["attribution"]["origin"] == "corpus"))
    counted = good.select(
        "response_id", F.size(F.array_distinct(F.transform(corpus, lambda b: b["section_id"]))).alias("voices"), F.coalesce("n_sections", F.lit(0)).alias("offered"),
        F.size(_traditions(F.transform(corpus, lambda b: b["attribution"]["tradition"]))).alias("used"), F.size(_traditions(F.col("traditions"))).alias("available"),
    )
    few = F.col("voices") < F.least(F.lit(min_voices), "offered")
    narrow = (F.col("available") >= 2) & (F.col("used") < F.least(F.lit(min_traditions), "available"))
    out.append(counted.select("response_id", F.lit(None).cast("int").alias("block"), found(finding(few, "diversity_voices"), finding(narrow, "diversity_traditions"))))
    return reduce(DataFrame.unionByName, out)


def _number(text: Column) -> Column:
    """A whole number that came as one or as text; null for anything else."""
    return F.when(text.rlike(r"^\s*-?\d+\s*$"), F.trim(text).try_cast("bigint"))


def normalized_answers(answers: DataFrame, sections: DataFrame) -> DataFrame:
    """answers (response_id, body, ...) with what must not fail a check for its form set right, before violations().

    Numbers written as text become numbers. A voice gets the attribution of the section it
    cites, by place from 1 among those it was offered, whatever it typed; the section's
    origin counts, else the one claimed, else corpus. A quote that drifts from the section is cut to
    its verbatim beginning, if that is enough of it. A place that wasn't offered, and a body that isn't JSON with
    blocks, stay as they are. sections: response_id, place, author, work, tradition, slug, origin, body.
    """
    loose = ANSWER.replace("bigint", "string")
    parsed = answers.withColumn("_a", F.from_json("body", loose))
    whole = {"start": "start", "end": "end", "source_id": "source_id"}
    numbers = lambda r, names: F.struct(*[(_number(r[n]) if n in whole else r[n]).alias(n) for n in names])
    block = parsed.where("_a.blocks is not null").select("response_id", F.posexplode("_a.blocks").alias("_at", "b"))
    voice = F.col("b.type") == "voice"
    s = sections.select("response_id", F.col("place").cast("long").alias("_place"), F.struct("author", "work", "tradition", "slug", "origin", "body").alias("s"))
    cited = block.withColumn("_place", F.when(voice, _number(F.col("b.section_id")))).join(s, ["response_id", "_place"], "left")
    claimed = F.when(F.col("b.attribution.origin").isin("corpus", "user_library"), F.col("b.attribution.origin"))
    typed, own = F.col("b.attribution"), F.col("s")
    stated = F.struct(
        own["author"].alias("author"), own["work"].alias("work"), F.nullif(own["slug"], F.lit("")).alias("slug"), F.lit(None).cast("int").alias("year"),
        own["tradition"].alias("tradition"), F.coalesce(own["origin"], claimed, F.lit("corpus")).alias("origin"),
    )
    quote = F.coalesce(snapped_quote(F.col("b.quote"), own["body"]), F.col("b.quote"))
    right = F.struct(
        F.col("b.type").alias("type"), F.col("b.text").alias("text"), _number(F.col("b.section_id")).alias("section_id"), F.when(own.isNotNull(), stated).otherwise(typed).alias("attribution"), quote.alias("quote"),
        F.col("b.summary").alias("summary"), F.transform("b.anchors", lambda r: numbers(r, ("start", "end"))).alias("anchors"),
        F.transform("b.items", lambda r: numbers(r, ("start", "end", "translation", "source_id", "title", "author", "note"))).alias("items"),
    )
    # An answer's blocks are few, so they come together again as one array.
    blocks = cited.select("response_id", "_at", right.alias("b")).groupBy("response_id").agg(F.array_sort(F.collect_list(F.struct("_at", "b"))).alias("_blocks"))
    both = parsed.join(blocks, "response_id", "left")
    body = F.to_json(F.struct(F.col("_a.contract_version").alias("contract_version"), F.col("_a.teacher").alias("teacher"), F.col("_blocks.b").alias("blocks")))
    return both.withColumn("body", F.when(F.col("_blocks").isNotNull(), body).otherwise(F.col("body"))).select(answers.columns)


def pass_rates(answers: DataFrame, found: DataFrame, suite: str = "suite") -> DataFrame:
    """(suite, n, n_passed, rate): answers without a violation."""
    failed = found.select("response_id").distinct().withColumn("failed", F.lit(1))
    judged = answers.select("response_id", suite).join(failed, "response_id", "left")
    n, passed = F.count("*"), F.count_if(F.col("failed").isNull())
    return judged.groupBy(suite).agg(n.alias("n"), passed.alias("n_passed"), F.round(passed / n, 6).alias("rate"))
