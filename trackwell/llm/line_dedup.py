"""Removal of repeated multi-line passages by content-defined line chunks, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackwell.llm.common import Scratch, free_name, settled

#: Weights of the newest and the two lines before it in the rolling hash, and the mean lines of a chunk.
WEIGHTS = (1, 257, 66049)
MEAN_LINES = 3
#: Tasks over which a hash that many rows share is dealt in joins.
SALT = 8


def line_hash(line: Column) -> Column:
    """The first 32 bits of a line's MD5, as a long."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def text_hash(text: Column) -> Column:
    """The first 60 bits of a text's MD5, as a long; it orders rows of one id. Null: -1."""
    return F.coalesce(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(-1))


def with_chunks(docs: DataFrame, name: str, mean_lines: int = MEAN_LINES) -> DataFrame:
    """docs with an array column of chunks: struct(k, n_lines, n_solid, body), whose bodies joined by line feeds are the text.

    A chunk ends after a line when the rolling hash of it and the two lines before it is 0
    modulo mean_lines, so boundaries depend on nearby lines only and move with inserted text.
    """
    lines, sums, starts = (free_name(docs, f"_{x}") for x in ("lines", "sums", "starts"))
    out = settled(docs, {lines: F.split(F.coalesce("text", F.lit("")), "\n")})
    out = settled(out, {sums: F.transform(lines, line_hash)})

    def ends(i: Column) -> Column:
        rolled = sum(
            F.when(i >= n, F.get(F.col(sums), i - n)).otherwise(F.lit(0)) * F.lit(weight)
            for n, weight in enumerate(WEIGHTS)
        )
        return rolled % mean_lines == 0

    out = settled(out, {starts: F.filter(
        F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | ends(i - 1)
    )})

    def chunk(s: Column, k: Column) -> Column:
        stop = F.coalesce(F.get(F.col(starts), k + 1), F.size(lines))
        own = F.slice(F.col(lines), s + 1, stop - s)
        return F.struct(
            k.alias("k"), (stop - s).alias("n_lines"),
            F.size(F.filter(own, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).alias("n_solid"),
            F.array_join(own, "\n").alias("body"),
        )

    out = settled(out, {name: F.transform(starts, chunk)})
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], name)


def remove_repeats(docs: DataFrame, mean_lines: int = MEAN_LINES, scratch: Scratch | None = None) -> DataFrame:
    """docs with a struct column `dedup`: n_lines, n_chunks, removed_chunks, removed_lines, clean_text.

    A chunk of two or more lines that aren't blank, found byte for byte more than once, stays
    only where it comes first by (doc_id, hash of the text, place in the text), null ids first.
    Chunks are counted by a 64-bit hash, combined before the shuffle; only those whose hash
    comes up again travel with their bytes, which grouping then compares. Rows that agree in
    doc_id and text are treated alike. Null text has one blank line and stays null. An empty
    table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "line-dedup")
    name, cs = free_name(docs, "dedup"), free_name(docs, "_chunks")
    row_id, row_hash, gone = (free_name(docs, f"_{x}") for x in ("row_id", "row_hash", "gone"))
    keyed = docs.withColumns({
        row_id: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), row_hash: text_hash(F.col("text")),
    })
    chunked = with_chunks(keyed.select(row_id, row_hash, "text"), cs, mean_lines)
    found = (
        chunked.select(F.col(row_id).alias("d"), F.col(row_hash).alias("t"), F.explode(cs).alias("c"))
        .where("c.n_solid > 1").select("d", "t", F.col("c.k").alias("k"), F.xxhash64("c.body").alias("h"), F.col("c.body").alias("body"))
    )
    again = found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    repeated = scratch.save(found.join(again, "h", "left_semi"))
    place = F.struct("d", "t", "k")
    first = repeated.groupBy("h", "body").agg(F.min(place).alias("first"))
    drop = (
        repeated.join(first, ["h", "body"]).where(place != F.col("first"))
        .groupBy(F.col("d").alias(row_id), F.col("t").alias(row_hash)).agg(F.collect_set("k").alias(gone))
    )
    out = with_chunks(keyed.join(drop, [row_id, row_hash], "left"), cs, mean_lines)
    none = F.array().cast("array<int>")
    out = settled(out, {gone: F.coalesce(gone, none)})
    stays = F.filter(cs, lambda c: ~F.array_contains(F.col(gone), c["k"]))
    count = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda n, c: n + c["n_lines"])
    text = F.when(F.col("text").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stays, lambda c: c["body"]), "\n"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.struct(
        count(F.col(cs)).alias("n_lines"), F.size(cs).cast("long").alias("n_chunks"),
        F.size(gone).cast("long").alias("removed_chunks"), (count(F.col(cs)) - count(stays)).alias("removed_lines"),
        text.alias("clean_text"),
    ).alias(name))


def with_windows(docs: DataFrame, name: str) -> DataFrame:
    """docs with an array column of windows: struct(k, e, h) for each two solid lines that follow each other.

    k and e are the places of the two lines, between which only blank ones stand, and h is the MD5 of both.
    """
    lines, solid = free_name(docs, "_lines"), free_name(docs, "_solid")
    out = settled(docs, {lines: F.split(F.coalesce("text", F.lit("")), "\n")})
    out = settled(out, {solid: F.filter(
        F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(F.col(lines), i).rlike(r"[^\x20\x09-\x0D]")
    )})

    def window(k: Column, n: Column) -> Column:
        e = F.get(F.col(solid), n + 1)
        both = F.concat(F.get(F.col(lines), k), F.lit("\n"), F.get(F.col(lines), e))
        return F.struct(k.alias("k"), e.alias("e"), F.unhex(F.md5(both.cast("binary"))).alias("h"))

    out = settled(out, {name: F.filter(F.transform(solid, window), lambda w: w["e"].isNotNull())})
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], name)


def remove_passages(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """docs with a struct column `dedup`: n_lines, removed_lines, clean_text.

    Every run of two or more whole solid lines that came before, by (doc_id, hash of the text,
    place in the text), null ids first, goes, wherever it stands in its text; blank lines within
    it don't count and go with it. Its boundaries are where the windows of two lines, all of which
    are hashed, begin and end to repeat, so they move with inserted text. Windows are counted by 128-bit
    digests, combined before the shuffle, and compared by them: bytes stay where they are. Joins on
    a digest are dealt over SALT tasks, so that one very common window is shared. Texts stream past
    what goes from them, so a task holds the places of a partition's removed lines, not its texts. A window that overlaps its own first occurrence isn't a repeat, so the
    first occurrence of every line stays. Rows that agree in doc_id and text are treated
    alike. Null text has one blank line and stays null. An empty table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "passage-dedup")
    name, ws = free_name(docs, "dedup"), free_name(docs, "_windows")
    row_id, row_hash, gone, lines, stays = (free_name(docs, f"_{x}") for x in ("row_id", "row_hash", "gone", "lines", "stays"))
    keyed = docs.withColumns({row_id: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), row_hash: text_hash(F.col("text"))})
    found = (
        with_windows(keyed.select(row_id, row_hash, "text"), ws)
        .select(F.col(row_id).alias("d"), F.col(row_hash).alias("t"), F.explode(ws).alias("w"))
        .select("d", "t", "w.*", F.pmod(F.xxhash64("d", "w.k"), F.lit(SALT)).cast("int").alias("salt"))
    )
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
    again = found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h", salts)
    repeated = scratch.save(found.join(again, ["h", "salt"], "left_semi"))
    first = repeated.groupBy("h").agg(F.min(F.struct("d", "t", "k", "e")).alias("first")).select("h", "first", salts)
    drop = (
        repeated.join(first, ["h", "salt"]).where("not (d = first.d and t = first.t and k <= first.e)")
        .groupBy(F.col("d").alias(row_id), F.col("t").alias(row_hash))
        .agg(F.flatten(F.collect_set(F.sequence("k", "e"))).alias(gone))
    )
    out = keyed.join(drop.hint("shuffle_hash"), [row_id, row_hash], "left")
    out = settled(out, {lines: F.split(F.coalesce("text", F.lit("")), "\n"), gone: F.coalesce(gone, F.array().cast("array<int>"))})
    out = settled(out, {stays: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))})
    kept = F.array_join(F.transform(stays, lambda i: F.get(F.col(lines), i)), "\n")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.struct(
        F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(stays)).cast("long").alias("removed_lines"),
        F.when(F.col("text").isNull(), F.col("text")).otherwise(kept).alias("clean_text"),
    ).alias(name))


def clean(docs: DataFrame) -> DataFrame:
    """docs with repeated passages gone; documents of which nothing but blank lines remains, though there was more, go too.

    Null and blank texts stay as they are. Repeated rows are treated alike: all lose what a smaller
    id has before. n_chars follows the text where docs have it. An empty table stays empty.
    """
    name = free_name(docs, "dedup")
    out = remove_passages(docs)
    solid = r"[^\x20\x09-\x0D]"
    out = out.where(F.col("text").isNull() | (F.col(f"{name}.removed_lines") == 0) | F.col(f"{name}.clean_text").rlike(solid))
    new = {"text": F.col(f"{name}.clean_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(F.col(f"{name}.clean_text")).cast(docs.schema["n_chars"].dataType)
    return out.withColumns(new).select(*[F.col(f"`{c}`") for c in docs.columns])
