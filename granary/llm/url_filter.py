"""URL filters in DataFrame functions only: host and path rules, else a logistic regression.

The regression sees hashed character n-grams of host and path and learns from a small labelled URL
table (at most ``MAX_LABELLED`` rows, a bound of the method: the training runs over the matrix of
inner products of the labelled rows). Training is full-batch gradient descent in its dual form: the
weights are sums of the labelled rows times one coefficient each, so each step updates one number
per labelled row; the steps run in one aggregate() over one row. The built-in table is made by a rule from
words of unwanted and of ordinary sites; prefixes, ends and paths are drawn alike for both classes, so that none of them tells anything. The weights are an array of
``BUCKETS`` doubles, whatever the size of the table that is judged, and scoring needs no shuffle.

A null URL, or one without "://", has an empty host and path; no rule fits it and the regression
scores its empty text. Repeated rows each get a row; an empty table gives an empty result; extra
columns are kept, and those named like a new column are replaced.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

BUCKETS, GRAMS, MAX_LABELLED, PATH_SHARE = 8192, (3, 4, 5), 500, 0.25
STEPS, RATE, DECAY = 250, 6.0, 1e-4

#: Fixed values: (host, path, verdict), in the order of the contract.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

#: Words that the names of the small labelled table are made of, for unwanted and for ordinary sites.
UNWANTED = (
    "casino", "poker", "jackpot", "slots", "betting", "viagra", "pills", "meds", "porn", "xxx", "adult", "cams", "escort", "loans", "payday", "cash", "prize", "bonus", "free", "cheap",
    "deals", "replica", "warez", "crack", "torrent", "keygen", "spam", "seo", "backlinks", "followers", "clicks", "ads", "popup", "tracker", "banner", "winner",
    "bets", "gambling", "lottery", "roulette", "nude", "hacks", "cheats", "diet",
)
ORDINARY = (
    "library", "museum", "garden", "school", "weather", "history", "recipes", "travel", "music", "science", "archive", "health", "sports", "radio", "theatre", "nature", "cooking", "astronomy", "knitting", "bakery",
    "timetable", "orchestra", "hospital", "cycling", "council", "swimming", "botany", "village", "river", "mountain", "harbour", "bridge", "market", "letters", "poems", "maps", "birds", "planets", "chess", "choir",
    "meadow", "forest", "railway", "tiles", "pottery", "lessons", "grammar", "physics", "anthill", "harvest", "stones", "windmill", "sailing", "painting", "journal", "gazette", "notes", "diary", "kitchen", "atlas",
)
#: What both classes get alike.
PREFIXES = ("", "", "www.", "www.", "blog.", "m.", "shop.", "news.", "en.", "static.")
TLDS = ("com", "net", "org", "info", "io", "example.com", "example.net", "example.org", "co.uk", "de")
LABEL_PATHS = ("", "/", "/index.html", "/en/12", "/fr/7.html", "/de/345/", "/es/9", "/a/b/c", "/2024/05/post", "/item.php", "/page/81", "/en/4100", "/about", "/search/x")
SYLLABLES = ("an", "be", "co", "di", "er", "fa", "ga", "hi", "in", "ka", "le", "mo", "na", "or", "pe", "ra", "se", "ti", "un", "va", "th", "on", "st", "re")
#: Rows of each class: ordinary sites are the more frequent ones, and a name of letters that were never seen is one of them.
N_UNWANTED, N_ORDINARY = 150, 220


def made_up(kind: str, k: int) -> str:
    """The k-th URL of a class: a word, two words or (ordinary only) syllables, with a prefix, an end and a path that don't depend on the class."""

    def draw(what: str, options: tuple[str, ...]) -> str:
        return options[zlib.crc32(f"{kind}/{k}/{what}".encode()) % len(options)]

    words = UNWANTED if kind == "unwanted" else ORDINARY
    one, two = words[k % len(words)], draw("second", words)
    forms = (one, f"{one}-{two}", f"{one}{two}", f"{two}-{one}", f"{one}-{draw('tail', SYLLABLES)}")
    if kind == "ordinary" and k % 3 == 0:
        forms = ("".join(draw(f"syllable{j}", SYLLABLES) for j in range(2 + k % 4)),)
    return f"https://{draw('prefix', PREFIXES)}{draw('form', forms)}.{draw('end', TLDS)}{draw('path', LABEL_PATHS)}"


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The built-in labelled table: url, label (1: unwanted)."""
    rows = [(made_up("unwanted", k), 1) for k in range(N_UNWANTED)] + [(made_up("ordinary", k), 0) for k in range(N_ORDINARY)]
    values = ", ".join(f"('{u}', {y})" for u, y in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(url, label)")


def add_host_path(pages: DataFrame, url: str = "url") -> DataFrame:
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + F.lit(3), F.length(u))).otherwise(F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return pages.withColumns({"host": F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), upper, lower), "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)})


def grams(host: Column, path: Column) -> Column:
    """(b, x): buckets of the character n-grams of host (with its ends marked) and of path, repeats included, and their values.

    The n-grams of a host have length 1 together, those of a path ``PATH_SHARE``, so a long path doesn't drown a short host.
    """

    def of(kind: str, chars: Column, n: int) -> Column:
        at = F.when(F.size(chars) >= n, F.sequence(F.lit(0), F.size(chars) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.pmod(F.xxhash64(F.lit(kind), F.concat(*[F.get(chars, i + d) for d in range(n)])), F.lit(BUCKETS)).cast("int"))

    # an empty text has no characters; a lambda's argument is made once, so the work grows with the length alone
    split = lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ""))
    both = (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", path))
    out = [F.transform(F.array(split(s)), lambda chars: F.concat(*[of(kind, chars, n) for n in GRAMS]))[0] for kind, s in both]  # noqa: B023
    valued = lambda g, share: F.transform(F.array(g), lambda bs: F.transform(bs, lambda b: F.struct(b.alias("b"), (F.lit(share) / F.sqrt(F.size(bs).cast("double"))).alias("x"))))[0]
    return F.concat(valued(out[0], 1.0), valued(out[1], PATH_SHARE))


def train(labelled: DataFrame) -> list[float]:
    """Weights of the buckets, the bias last. labelled: url, label (1: unwanted); rows with nulls are left out."""
    rows = add_host_path(labelled.filter("url is not null and label is not null").select("url", F.col("label").cast("double").alias("y")))
    rows = rows.dropDuplicates(["url", "y"]).orderBy(F.xxhash64("url"), "url", "y").limit(MAX_LABELLED).coalesce(1)
    rows = rows.withColumn("g", grams(F.col("host"), F.col("path"))).select(F.xxhash64("url", "y").alias("i"), "y", "g")
    x = rows.select("i", F.explode("g").alias("g")).groupBy("i", F.col("g.b").alias("b")).agg(F.sum("g.x").alias("x"))
    other = x.select(F.col("i").alias("j"), "b", F.col("x").alias("z"))
    inner = x.join(other, "b").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("z")).alias("k"))
    ids = rows.select("i", "y")
    full = ids.join(inner, "i", "left").groupBy("i", "y").agg(F.map_from_entries(F.collect_list(F.when(F.col("j").isNotNull(), F.struct("j", "k")))).alias("row"))
    one = full.groupBy().agg(F.array_sort(F.collect_list(F.struct("i", "y", "row")), lambda a, b: F.when(a.i < b.i, -1).when(a.i > b.i, 1).otherwise(0)).alias("t"))
    # the matrix as arrays in the order of the rows, the bias as a constant 1 added to each product
    one = one.select("t", F.expr("transform(t, a -> transform(t, b -> coalesce(try_element_at(a.row, b.i), 0D) + 1D))").alias("m"))
    n = "greatest(size(t), 1)"
    step = f"""aggregate(sequence(1, {STEPS}), transform(t, a -> 0D), (alpha, s) ->
        transform(t, (a, i) -> alpha[i] * (1 - {RATE} * {DECAY}) + {RATE} / {n} * (a.y - 1 / (1 + exp(-aggregate(zip_with(m[i], alpha, (p, q) -> p * q), 0D, (u, v) -> u + v))))))"""
    alpha = one.select(F.explode(F.arrays_zip(F.col("t.i").alias("i"), F.expr(step).alias("a"))).alias("r")).select("r.i", "r.a")
    w = x.join(alpha, "i").groupBy("b").agg(F.sum(F.col("x") * F.col("a")).alias("w")).unionByName(alpha.groupBy().agg(F.sum("a").alias("w")).select(F.lit(BUCKETS).alias("b"), F.coalesce("w", F.lit(0.0)).alias("w")))
    weights = [0.0] * (BUCKETS + 1)
    for r in w.collect():  # at most BUCKETS + 1 rows
        weights[r.b] = r.w
    return weights


def score(host: Column, path: Column, weights: list[float]) -> Column:
    """Probability that a URL is unwanted."""
    w = F.from_json(F.lit(str(weights)), "array<double>")  # folded to one constant by the optimizer
    z = F.aggregate(grams(host, path), F.lit(0.0), lambda a, g: a + F.get(w, g["b"]) * g["x"])
    return 1 / (1 + F.exp(-(z + F.lit(float(weights[BUCKETS])))))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits the host or a parent domain and starts the path; null if none.

    Of rules of the same length, one that blocks goes first, then the smaller text.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "block", r[0] + r[1]))
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in ordered]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def judge(pages: DataFrame, weights: list[float], url: str = "url", rules=RULES, limit: float = 0.5) -> DataFrame:
    """Add host, path, rule, score and verdict (allow or block)."""
    out = add_host_path(pages, url).withColumn("__r", rule_for(F.col("host"), F.col("path"), rules))
    out = out.withColumns({"rule": F.col("__r.rule"), "score": score(F.col("host"), F.col("path"), weights)})
    return out.withColumn("verdict", F.coalesce(F.col("__r.verdict"), F.when(F.col("score") >= limit, F.lit("block")).otherwise(F.lit("allow")))).drop("__r")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, train(labelled_urls(spark))).select("page_id", "host", "path", "rule", "verdict", F.round("score", 9).alias("score"))
