"""URL filters by Bloom filter cascades: exact membership of keys without a join.

A key is a host suffix, or a rule (host suffix and path prefix). The first level of a cascade holds all listed keys.
The corpus's key universe is then read: its unlisted keys that pass the first level go into the second, listed keys
that pass the second into the third, and so on until no key passes wrongly. A key of the universe is listed if the
first level that it fails has an even number, or if it passes all of an odd number of levels. Testing a url reads a few
bit arrays; the urls are never joined or shuffled.

Only listed keys and false positives of one level are gathered (about one in 2,000 of the unlisted keys at the first
level), so the arrays grow with the list, not with the corpus. A level holds at most ``MAX_KEYS`` keys (64 MB of bits);
more raise an error instead of a broadcast without a bound.

Null urls and urls without ``://`` have an empty host and path; no rule fits them and nothing lists them: allow. Rows are
judged one by one, so repeated rows and extra columns change nothing; columns named like those added are replaced; an
empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from armlift.llm.shared import save

HASHES = 11
BITS_PER_KEY = 16
MAX_KEYS = 1 << 25
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words that list a host when one of its labels holds them between hyphens.
LISTED_WORDS = ("ad", "ads", "adserver", "tracker", "spam", "casino", "poker", "bets", "betting", "adult", "porn", "xxx",
                "pills", "viagra", "malware", "phishing")


def host_of(url: str = "url") -> Column:
    after = F.expr(f"CASE WHEN instr({url}, '://') > 0 THEN substring({url}, instr({url}, '://') + 3) ELSE '' END")
    return F.translate(F.regexp_extract(after, "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: str = "url") -> Column:
    after = F.expr(f"CASE WHEN instr({url}, '://') > 0 THEN substring({url}, instr({url}, '://') + 3) ELSE '' END")
    return F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)


def host_suffixes(host: str = "host") -> Column:
    """The host and all hosts above it."""
    return F.expr(f"transform(sequence(1, size(split({host}, '[.]'))), i -> substring_index({host}, '.', -i))")


def listed_hosts(pages: DataFrame, words: tuple[str, ...] = LISTED_WORDS, url: str = "url") -> DataFrame:
    """Keys of the corpus's hosts that have a label with one of the words, from that label on."""
    label = f"(?:[^.]*-)?(?:{'|'.join(words)})(?:-[^.]*)?"
    found = F.regexp_extract(host_of(url), rf"(?:^|[.])({label}[.].+)$", 1)
    return pages.select(found.alias("key")).where("key <> ''").distinct()


def rule_keys(host: str, path: str, rules: list[str]) -> Column:
    """The (host suffix + path prefix) candidates of the lengths that the rules have."""
    shapes = sorted({(r.split("/", 1)[0].count(".") + 1, len(r) - r.index("/")) for r in rules})
    keys = [F.when(
        F.expr(f"size(split({host}, '[.]')) >= {labels} AND length({path}) >= {length}"),
        F.expr(f"concat(substring_index({host}, '.', -{labels}), substring({path}, 1, {length}))"))
        for labels, length in shapes]
    return F.array_compact(F.array(*keys)) if keys else F.array().cast("array<string>")


class Cascade:
    """Levels of Bloom filters; ``listed(key)`` is exact for keys of the universe it was built over.

    ``attach`` puts the bit arrays beside the rows, as subqueries of one row that Spark evaluates once; ``listed`` can
    then be used in any expression over them."""

    def __init__(self, name: str):
        self.name = name
        self.levels: list[tuple[DataFrame, int]] = []  # (one row with column bits, number of bits)

    @classmethod
    def build(cls, name: str, listed: DataFrame, universe: DataFrame) -> Cascade:
        """``listed``: column key; ``universe``: column keys, an array of keys per row of the corpus."""
        self = cls(name)
        inside = save(listed.select("key").where("key IS NOT NULL").distinct(), "listed")
        encode, other = inside, None
        while count := encode.count():
            if count > MAX_KEYS:
                raise ValueError(f"{count} keys in one level; split the list over several cascades")
            self.levels.append(_level(encode, count, len(self.levels) + 1))
            last = len(self.levels) - 1
            if other is None:  # the one pass over the corpus: only keys that pass the first level leave the scan
                passing = self.attach(universe).select(F.explode(F.filter(
                    "keys", lambda k: self._passes(k, 0))).alias("key")).distinct()
                wrong = save(passing.join(inside, "key", "left_anti"), "passing")
            else:
                wrong = save(self.attach(other).where(self._passes(F.col("key"), last)).select("key"), "passing")
            encode, other = wrong, encode
        return self

    def _column(self, level: int) -> str:
        return f"_{self.name}_{level}"

    def attach(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({self._column(i): row.scalar() for i, (row, _) in enumerate(self.levels)})

    def _passes(self, key: Column, level: int) -> Column:
        def one(place: Column) -> Column:
            word = F.get(F.col(self._column(level)), F.shiftright(place, 6).cast("int"))
            return F.call_function("shiftright", word, (place % 64).cast("int")).bitwiseAND(
                F.lit(1).cast("bigint")) == 1

        return reduce(lambda a, b: a & b, map(one, _places(key, self.levels[level][1], level + 1)))

    def listed(self, key: Column) -> Column:
        # from the last level back: the first failed level decides
        result = F.lit(len(self.levels) % 2 == 1)
        for level in range(len(self.levels) - 1, -1, -1):
            result = F.when(self._passes(key, level), result).otherwise(F.lit(level % 2 == 1))
        return result


def _places(key: Column, bits: int, seed: int) -> list[Column]:
    size = F.lit(bits).cast("bigint")
    first, second = F.pmod(F.xxhash64(key, F.lit(seed)), size), F.pmod(F.xxhash64(F.lit(seed), key), size)
    return [F.pmod(first + F.lit(i) * second, size) for i in range(HASHES)]


def _level(keys: DataFrame, count: int, seed: int) -> tuple[DataFrame, int]:
    bits = max(64, 1 << (count * BITS_PER_KEY - 1).bit_length())
    places = keys.select(F.explode(F.array(*_places(F.col("key"), bits, seed))).alias("place"))
    words = places.groupBy(F.expr("place DIV 64").alias("id")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(place % 64 AS INT)))").alias("word"))
    dense = keys.sparkSession.range(bits // 64).join(words, "id", "left")
    row = dense.select(F.struct("id", F.coalesce("word", F.lit(0).cast("bigint")).alias("word")).alias("w")).agg(
        F.transform(F.array_sort(F.collect_list("w")), lambda w: w["word"]).alias("bits"))
    return save(row, "level"), bits


def judge_urls(
    pages: DataFrame, allow: list[str], block: list[str], listed: DataFrame | None = None, url: str = "url",
) -> DataFrame:
    """Adds host, path, rule and verdict. The longest fitting rule decides; without one, a listed host (or a host
    below it) is blocked and any other allowed. ``listed`` has a column key of hosts."""
    spark: SparkSession = pages.sparkSession
    listed = listed_hosts(pages, url=url) if listed is None else listed
    rows = pages.withColumn("host", host_of(url)).withColumn("path", path_of(url))
    rows = rows.withColumn("_rules", rule_keys("host", "path", [*allow, *block])).withColumn(
        "_hosts", host_suffixes())
    keys = lambda rules: spark.createDataFrame([(r,) for r in rules], "key string")
    allowed = Cascade.build("allow", keys(allow), rows.select(F.col("_rules").alias("keys")))
    blocked = Cascade.build("block", keys(block).union(listed.select("key")), rows.select(
        F.concat("_rules", "_hosts").alias("keys")))
    made = ["host", "path", "rule", "verdict", "listed"]
    columns = [*(c for c in pages.columns if c not in made), *made]
    rows = blocked.attach(allowed.attach(rows))
    found = F.transform("_rules", lambda k: F.struct(
        F.length(k).alias("length"), k.alias("rule"),
        F.when(allowed.listed(k), "allow").when(blocked.listed(k), "block").alias("verdict")))
    best = F.array_max(F.filter(found, lambda f: f["verdict"].isNotNull()))
    rows = rows.withColumn("_best", best).withColumn(
        "listed", F.exists("_hosts", lambda h: blocked.listed(h)))
    return rows.withColumn("rule", F.col("_best.rule")).withColumn("verdict", F.coalesce(
        F.col("_best.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))).select(*columns)


def check_sql(allow: list[str], block: list[str], words: tuple[str, ...] = LISTED_WORDS) -> str:
    """The same verdicts by plain string tests, for another database."""
    label = f"(?:[^.]*-)?(?:{'|'.join(words)})(?:-[^.]*)?"
    rules = ", ".join(f"('{r}', '{v}')" for v, rs in (("allow", allow), ("block", block)) for r in rs)
    return f"""WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0
            THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        rules(rule, v) AS (VALUES {rules}),
        cuts AS (SELECT rule, v, split_part(rule, '/', 1) AS h, substring(rule, instr(rule, '/')) AS p FROM rules),
        fits AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v
            FROM parts JOIN cuts ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
        SELECT page_id, host, path, fits.rule, coalesce(fits.v, CASE WHEN
            regexp_matches(host, '(?:^|[.]){label}[.].+$') THEN 'block' ELSE 'allow' END) AS verdict,
            regexp_matches(host, '(?:^|[.]){label}[.].+$') AS listed
        FROM parts LEFT JOIN fits USING (page_id)"""
