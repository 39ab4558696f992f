"""URL filters: a blocked Bloom filter of the listed canonical URLs in front of an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenesift.llm.common import stored

#: Bits of a block's word; each block has LANES words, and a key sets one bit in each.
LANES, WORD = 4, 63
#: Listed keys for each block: about 25 bits for a key.
KEYS_PER_BLOCK = 10
#: Most blocks of a filter (1 MB). A list of over 330,000 keys fills them more, so more keys pass to the exact join in error.
MAX_BLOCKS = 1 << 15
#: A listed key is joined in as many copies, so that the frames of a hot key meet it in several tasks.
SALT = 16


def url_parts(url: Column) -> tuple[Column, Column]:
    """Canonical (host, path) of a URL; both empty for null and for text without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bit(key: Column, lane: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(key, F.lit(lane)), F.lit(WORD)).cast("int"))


def bloom_words(listed: DataFrame, blocks: int) -> Column:
    """The filter as a constant array, the words of a block's lanes one after the other; at most 1 MB.

    The blocks are filled on Spark. The array passes the driver as one text, which the optimizer folds to a constant.
    """
    key = F.col("key")
    held = listed.groupBy(_block(key, blocks).alias("block")).agg(*[F.bit_or(_bit(key, n)).alias(f"w{n}") for n in range(LANES)])
    words = [0] * (LANES * blocks)
    for row in held.collect():
        words[LANES * row["block"] : LANES * (row["block"] + 1)] = row[1:]
    return F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")


def may_be_listed(key: Column, words: Column, blocks: int) -> Column:
    """True for every listed key and for few others: each lane of the key's block has the key's bit."""
    lanes = F.slice(words, _block(key, blocks) * LANES + 1, LANES)
    return F.forall(F.zip_with(lanes, F.array(*[_bit(key, n) for n in range(LANES)]), lambda w, b: w.bitwiseAND(b) != 0), lambda x: x)


def filter_urls(frames: DataFrame, rules: DataFrame, url: str = "image_url", default: str = "allow") -> DataFrame:
    """Judge the image URL of every frame by the listed rules.

    The annotation project keeps no URLs in its own records, so this operator is general: ``frames`` is any table
    with a URL column; its columns are kept, and host, path, rule and verdict are added (a column of the table that
    has one of these names is replaced). ``rules(host, path, verdict)`` lists canonical host and path prefixes; a
    rule fits its host and all subdomains when the URL's path starts with the rule's, and the longest text of host
    and path wins. A page has one candidate key for each host suffix and each path length in use. The filter is a
    constant array of at most 1 MB, so keys are tested inside their row, before any shuffle; frames
    without a key that passes are done. The others are written with a row number, so that a task run again cannot
    number them otherwise, and their passed keys are joined with the list itself, which removes false positives.

    Null URLs, empty ones and those without ``://`` have an empty host and path, no rule and the verdict
    ``default``. A rule listed twice counts once (block before allow). With no rules every verdict is the default.
    """
    listed = (
        rules.filter(F.col("host").isNotNull() & (F.col("host") != ""))
        .select(F.concat(F.col("host"), F.coalesce("path", F.lit("/"))).alias("key"), F.length(F.coalesce("path", F.lit("/"))).alias("depth"), "verdict")
        .groupBy("key", "depth").agg(F.max("verdict").alias("verdict"))
    )
    # One row of numbers: how many keys, and the path lengths that occur.
    n_keys, depths = listed.agg(F.count("*"), F.sort_array(F.collect_set("depth"))).first()
    blocks = min(MAX_BLOCKS, max(1, -(-n_keys // KEYS_PER_BLOCK)))
    own = [c for c in frames.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    host, path = url_parts(F.col(url))
    base = frames.select(F.struct(*own).alias("frame"), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.substring("path", 1, int(d)) for d in depths or [0]]), lambda p: F.length(p) > 0)
    keys = F.when(F.col("host") != "", F.flatten(F.transform(suffixes, lambda h: F.transform(F.array_distinct(prefixes), lambda p: F.concat(h, p)))))
    words = bloom_words(listed.select("key"), blocks)
    base = base.withColumn("passed", F.filter(F.array_distinct(keys), lambda k: may_be_listed(k, words, blocks)))
    passes = F.coalesce(F.size("passed"), F.lit(0)) > 0
    held = stored(base.filter(passes).withColumn("row", F.monotonically_increasing_id()))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
    exact = listed.select("key", F.col("verdict").alias("found"), salts.alias("salt"))
    asked = held.select("row", F.pmod(F.xxhash64("row"), F.lit(SALT)).cast("int").alias("salt"), F.explode("passed").alias("key"))
    best = asked.join(exact, ["key", "salt"]).groupBy("row").agg(F.max(F.struct(F.length("key").alias("n"), F.col("key").alias("rule"), F.col("found").alias("verdict"))).alias("best"))
    none = F.lit(None).cast("string")
    judged = held.join(best, "row", "left").select("frame", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    rest = base.filter(~passes).select("frame", "host", "path", none.alias("rule"), F.lit(default).alias("verdict"))
    return judged.unionByName(rest).select("frame.*", "host", "path", "rule", "verdict")
