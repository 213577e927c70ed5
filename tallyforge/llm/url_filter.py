"""URL filters: fixed host and path rules, then logistic regression on hashed character n-grams of host and path.

All of it is SQL functions. The labelled table is small, so the model is fitted in its dual form: gradient descent moves one
coefficient for each labelled URL, over the table of n-grams that two URLs share, as higher-order functions over one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Length of an n-gram, number of buckets they are hashed to, rounds, step and weight decay of the fit.
GRAM, BUCKETS, ROUNDS, STEP, DECAY = 3, 4093, 300, 0.05, 0.002
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Host, path and verdict of the rules; the longest that fits wins.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)

#: The labelled URL table, everyday sites and eight kinds of unwanted ones, each kind a line.
ALLOWED = """
    garden weather townmuseum university recipes slowtravel cyclingclub chess
    science health cinema theatre pottery-studio villagehall orchestra harbour
    hikingtrails novels bakery dentist streetmaps school council coffee
    paintings birdwatching football swimming knitting-patterns astronomy-society geology poetry
    radio ferries railway carpentry beekeepers lighthouse market dictionary
    grammar physics chemistry algebra-lessons parishchoir allotment canalboats bridges
    camping kayak sailingschool archive census library languages newspaper
    furniture candles umbrellas bookbinding lampshades embroidery blacksmith walking
    jewellery mountains waterfalls
""".split()
BLOCKED = """
    grand-casino casino-bonus vegascasino casino-tables livecasino casino-lotto
    buy-pills pillstore diet-pills pills-direct bluepills sleeping-pills
    sportsbets bets-today livebets bets-and-odds betsbonus top-bets
    adultvideos adult-dating adultclips xxxadult adultcams xxx-adult-clips
    popads ads-network adsclick clickads ads-exchange adspixel
    spamlinks seo-spam linkspam buy-linkspam spamblast spam-mailing
    keygen-crack serialcrack crackedgames warez-crack cracksoft crack-keygen
    paydayloans instant-loans loans-approved loans-cash fastloans bad-credit-loans
""".split()
KIND = 6
_PLACES = ("", "www."), (".com", ".info", ".co.uk", ".de", ".org", ".net"), ("/", "/about.php", "/index.html?", "/store/item", "/2019/03/page", "/view.aspx", "/contact", "/list/all", "/p/")
#: The labelled URL table (host, path, 1: block): each name at a place that its number gives, alike for both labels.
LABELLED = tuple((_PLACES[0][k % 2] + name + _PLACES[1][k % 6], _PLACES[2][k % 9].rstrip("?"), label) for label, names in enumerate((ALLOWED, BLOCKED)) for k, name in enumerate(names))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: the host up to ``/``, ``?``, ``#`` or the end with A-Z in lower case; the path up to ``?``, ``#`` or
    the end. Null or no ``://``: both ''."""
    parts = r"://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, parts, k), F.lit("")) for k in (1, 2))
    return F.translate(host, UPPER, LOWER), path


def grams(host: Column, path: Column) -> Column:
    """Distinct buckets of the n-grams of ``^host path$``."""
    chars = F.transform(F.split(F.concat(F.lit("^"), host, path, F.lit("$")), ""), lambda c: F.ascii(c).cast("long"))
    # the characters are bound to a variable, so that they are split once for each URL
    at = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - (GRAM - 1)), lambda i: ((F.get(c, i - 1) * 131 + F.get(c, i)) * 131 + F.get(c, i + 1)) % BUCKETS)
    return F.array_distinct(F.get(F.transform(F.array(chars), at), F.lit(0)))


def labelled(spark: SparkSession, rows=LABELLED) -> DataFrame:
    """The labelled table as a literal relation: id, host, path, label."""
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = ", ".join(f"({k}, {quoted(h)}, {quoted(p)}, {int(y)})" for k, (h, p, y) in enumerate(rows))
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(id, host, path, label)")


def fit(table: DataFrame) -> DataFrame:
    """One row: ``weights``, an array with a weight for each bucket and the intercept after them.

    The table (id, host, path, label) is the small labelled one: it is brought into one row. Repeated rows count repeatedly; an
    empty table gives weights of 0."""
    rows = table.select("id", F.col("label").cast("double").alias("y"), F.array_append(grams(F.col("host"), F.col("path")), F.lit(BUCKETS).cast("long")).alias("x"))
    one = rows.agg(F.array_sort(F.collect_list(F.struct("id", "y", "x"))).alias("e"))

    def fitted(v):  # v.e and v.k are variables of a lambda, so that they are computed once and not in each round
        def step(alpha, _):
            def moved(a, i):
                z = F.aggregate(F.zip_with(alpha, F.get(v["k"], i), lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)
                return a * (1 - DECAY) + STEP * (F.get(v["e"], i)["y"] - 1 / (1 + F.exp(-z)))

            return F.transform(alpha, moved)

        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.transform(v["e"], lambda _: F.lit(0.0)), step)

    shared = lambda e: F.transform(e, lambda a: F.transform(e, lambda b: F.size(F.array_intersect(a["x"], b["x"])).cast("double")))
    with_shared = F.transform(F.array("e"), lambda e: F.struct(e.alias("e"), shared(e).alias("k")))
    one = one.select("e", F.get(F.transform(with_shared, fitted), F.lit(0)).alias("alpha"))
    # a bucket's weight: the coefficients of the URLs that have it
    terms = one.select(F.posexplode("e").alias("i", "r"), "alpha").select(F.explode("r.x").alias("g"), F.get("alpha", F.col("i")).alias("a"), "i")
    weights = terms.groupBy("g").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("i", "a"))), F.lit(0.0), lambda s, v: s + v["a"]).alias("w"))
    found = weights.agg(F.map_from_entries(F.collect_list(F.struct("g", "w"))).alias("m"))
    return found.select(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(BUCKETS).cast("long")), lambda g: F.coalesce(F.element_at("m", g), F.lit(0.0))).alias("weights"))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name (host and path) and verdict of the longest rule that fits, or nulls."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, weights: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule, verdict and score (columns of these names are replaced): the rule's verdict, else block
    where the regression's score is above 0.5.

    A null url or one without ``://`` has host and path '' and is scored as such. Very long urls are read whole; equal urls get
    equal verdicts; repeated rows stay. No rows: none."""
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "score")]
    if url not in kept:
        raise ValueError(f"no column {url}")
    host, path = host_and_path(F.col(f"`{url}`"))
    split = pages.select(*[F.col(f"`{c}`") for c in kept], host.alias("host"), path.alias("path"))
    # BUCKETS + 1 numbers, whatever the input: a constant of the plan
    w = F.split(F.lit(",".join(map(repr, weights.first()["weights"]))), ",").cast("array<double>")
    z = F.aggregate(grams(F.col("host"), F.col("path")), F.get(w, F.lit(BUCKETS)), lambda s, g: s + F.get(w, g))
    name, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    scored = split.select("*", name.alias("rule"), verdict.alias("fixed"), (1 / (1 + F.exp(-z))).alias("score"))
    return scored.select(*[F.col(f"`{c}`") for c in kept], "host", "path", "rule", F.coalesce("fixed", F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def url_report(pages: DataFrame) -> DataFrame:
    """The columns of ``op7``."""
    weights = fit(labelled(pages.sparkSession))
    return judge(pages.select("page_id", "url"), weights).select("page_id", "host", "path", "rule", "verdict")


def oracle() -> str:
    """The same in DuckDB, fit included."""
    values = ", ".join(f"({k}, '{h}', '{p}', {y})" for k, (h, p, y) in enumerate(LABELLED))
    codes = "list_transform(string_split('^' || host || path || '$', ''), lambda c: unicode(c)::BIGINT)"
    gram = f"list_distinct(list_transform(range(1, len(c) - {GRAM - 2}), lambda i: ((c[i] * 131 + c[i + 1]) * 131 + c[i + 2]) % {BUCKETS}))"
    longest = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    when = lambda k: " ".join(f"WHEN (host = '{r[0]}' OR ends_with(host, '.{r[0]}')) AND starts_with(path, '{r[1]}') THEN '{k(r)}'" for r in longest)
    return f"""
    WITH labelled(id, host, path, y) AS (VALUES {values}),
    coded AS (SELECT id, y::DOUBLE AS y, {codes} AS c FROM labelled),
    examples AS (SELECT id, y, list_append({gram}, {BUCKETS}::BIGINT) AS x FROM coded),
    shared AS (SELECT a.id, list(len(list_intersect(a.x, b.x))::DOUBLE ORDER BY b.id) AS k FROM examples a, examples b GROUP BY a.id),
    one AS (SELECT list(y ORDER BY id) AS ys, list(k ORDER BY id) AS ks, list(0.0::DOUBLE ORDER BY id) AS zero FROM examples JOIN shared USING (id)),
    fitted AS (
        WITH RECURSIVE r(n, alpha, ys, ks) AS (
            SELECT 0, zero, ys, ks FROM one
            UNION ALL
            SELECT n + 1, list_transform(range(1, len(alpha) + 1), lambda i: alpha[i] * (1 - {DECAY}) + {STEP} * (ys[i] - 1 / (1 + exp(-list_inner_product(alpha, ks[i]))))), ys, ks FROM r WHERE n < {ROUNDS}
        ) SELECT alpha FROM r WHERE n = {ROUNDS}
    ),
    weights AS (SELECT g, sum(alpha[id + 1]) AS w FROM (SELECT id, unnest(x) AS g FROM examples), fitted GROUP BY g),
    bias AS (SELECT w FROM weights WHERE g = {BUCKETS}),
    split AS (
        SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
               coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path, row_number() OVER () AS n
        FROM pages
    ),
    page_grams AS (SELECT n, unnest({gram}) AS g FROM (SELECT n, {codes} AS c FROM split)),
    scores AS (SELECT n, sum(coalesce(w, 0)) AS z FROM page_grams LEFT JOIN weights USING (g) GROUP BY n)
    SELECT page_id, host, path, CASE {when(lambda r: r[0] + r[1])} ELSE NULL END AS rule,
           CASE {when(lambda r: r[2])} WHEN coalesce(z, 0) + bias.w > 0 THEN 'block' ELSE 'allow' END AS verdict
    FROM split LEFT JOIN scores USING (n), bias
    """
