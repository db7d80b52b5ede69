"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import constants
from .spans import find, place

# The patterns of the three base kinds, in their order.
_NAMES = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
ASSIGN = rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
VALUE = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?"""
KINDS = ("assign", "access", "hex", "markov")

#: Strings that the models look at, and the mean log-likelihood ratio for a character pair from which one is a secret.
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
THRESHOLD = 0.6
#: Characters of the models: the printable ASCII ones, by code less 32.
WIDTH = 96

# Words that ordinary identifiers are made of.
WORDS = (
    "account action active address amount array average balance batch buffer build cache client column command config connection content "
    "context control count create customer data database date default delete device document element email encode entry error event "
    "field file filter format function group handler header history image index input instance invoice item language latest layout level "
    "library line list loader local location logger manager mapping market message method model module monitor network node number object "
    "option order output package page parent parser partition password path pattern payment period person pointer policy position price "
    "process product profile project property provider public query random reader record region register remote report request resource "
    "response result return review role route sample schedule schema search section secret select server service session setting shipping "
    "size source status storage store stream string style summary supplier system table target task template text time title token total "
    "transaction transfer translation transport type update upload user validation value vector version view warehouse window worker writer "
    "Geschwindigkeit Verantwortung Gesellschaft Entwicklung Wissenschaft Freundschaft Bundesrepublik Unternehmen responsabilidad "
    "comunicaciones administraciones naturalmente constitucionalmente internationalement gouvernement environnement developpement "
    "anticonstitutionnellement understanding international characteristics responsibility representation transformation"
).split()


def labelled_samples(spark: SparkSession, each: int = 4000) -> DataFrame:
    """Labelled strings (text, secret): random ones in five alphabets, and identifiers of words in five styles.

    Made from a counter by hashing, so they are the same everywhere. Pass your own samples to ``train`` instead if
    you have some.
    """
    n = spark.range(each)
    digest = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    coded = F.base64(F.unhex(digest("b")))
    random = F.element_at(
        F.array(
            F.substring(digest("a"), 1, 40),
            F.substring(coded, 1, 40),
            F.substring(F.upper(F.regexp_replace(coded, "[+/=]", "")), 1, 24),
            F.substring(F.regexp_replace(coded, "[+/=]", ""), 1, 32),
            F.translate(F.substring(coded, 1, 36), "+/=", "-_0"),
        ),
        (F.col("id") % 5 + 1).cast("int"),
    )
    words = constants(WORDS, "string")
    word = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(WORDS))) + 1).cast("int"))
    four = [word(k) for k in range(4)]
    ordinary = F.element_at(
        F.array(F.concat_ws("_", *four), F.concat(F.lower(four[0]), *[F.initcap(w) for w in four[1:]]), F.concat_ws("-", *four), F.upper(F.concat_ws("_", *four)), F.lower(F.concat(*four))),
        (F.col("id") % 5 + 1).cast("int"),
    )
    return n.select(random.alias("text"), F.lit(1).alias("secret")).union(n.select(ordinary.alias("text"), F.lit(0).alias("secret")))


def _pairs(chars: Column) -> Column:
    """Code of each two neighbouring characters; ``chars`` are printable ASCII."""
    code = F.transform(chars, lambda c: F.ascii(c) - 32)
    return F.zip_with(F.slice(code, 1, F.size(chars) - 1), F.slice(code, 2, F.size(chars) - 1), lambda a, b: a * WIDTH + b)


def train(samples: DataFrame, text: str = "text", secret: str = "secret") -> list[float]:
    """Log-likelihood ratio of each character pair: of a second character after a first, random to ordinary.

    Both models are first-order Markov chains with half a count added for each pair. Samples that are null, shorter
    than two characters or not printable ASCII teach nothing. The result has 96 x 96 numbers for any input.
    """
    usable = samples.where(F.col(text).rlike("^[ -~]{2,}$") & F.col(secret).isNotNull()).select(F.split(text, "").alias("c"), (F.col(secret) > 0).cast("int").alias("y"))
    rows = usable.select("y", F.explode(_pairs(F.col("c"))).alias("pair")).groupBy("pair").agg(F.sum("y").alias("random"), F.sum(1 - F.col("y")).alias("ordinary"))
    of = F.floor(F.col("pair") / WIDTH)
    first = rows.groupBy(of.alias("first")).agg(F.sum("random").alias("r"), F.sum("ordinary").alias("o"))
    chance = lambda n, total: F.log((n + 0.5) / (total + 0.5 * WIDTH))
    table = [0.0] * (WIDTH * WIDTH)
    joined = rows.withColumn("first", of).join(F.broadcast(first), "first")  # 96 rows at most
    for r in joined.select("pair", (chance(F.col("random"), F.col("r")) - chance(F.col("ordinary"), F.col("o"))).alias("ratio")).collect():
        table[r.pair] = r.ratio
    for r in first.select("first", (chance(F.lit(0), F.col("r")) - chance(F.lit(0), F.col("o"))).alias("ratio")).collect():
        for k in range(r.first * WIDTH, (r.first + 1) * WIDTH):
            table[k] = table[k] or r.ratio
    return table


def likelihood_ratio(string: Column, table: list[float]) -> Column:
    """Mean over a string's character pairs of the log-likelihood ratio, random to ordinary (0 if it has no pair)."""
    ratios = constants(table, "double")
    total = F.aggregate(_pairs(F.split(string, "")), F.lit(0.0), lambda s, p: s + F.get(ratios, p))
    return F.when(F.length(string) > 1, total / (F.length(string) - 1)).otherwise(0.0)


def scan(docs: DataFrame, table: list[float], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Append secrets: array of (start, end, kind, match), by start, then in the order of the kinds.

    Base kinds are leftmost non-overlapping matches: assign (a name, a sign, a value of 6 or more characters; the
    span is the whole match), access (20 or more characters), hex (24 or more). Kind markov adds strings of 20 or
    more characters that the models hold for random and that overlap no base span. Offsets are code points, ends
    exclusive. Null texts have none. Columns named like results are replaced.
    """
    names = ["secrets", *[f"_{k}{part}" for k in KINDS for part in ("", "_pieces", "_matches")]]
    columns = [c for c in docs.columns if c.lower() not in names]
    whole = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(whole)
    named = low.contains("password") | low.contains("passwd") | low.contains("secret") | low.contains("token") | low.contains("apikey") | low.contains("api_key")
    found = {"assign": find(whole, ASSIGN, named), "access": find(whole, ACCESS, whole.contains("AKIA")), "hex": find(whole, "[0-9a-f]{24,}"), "markov": find(whole, CANDIDATE)}
    out = docs.select(columns)
    for kind, (pieces, matches) in found.items():
        out = out.withColumns({f"_{kind}_pieces": pieces, f"_{kind}_matches": matches})
    out = out.withColumns({f"_{kind}": place(F.col(f"_{kind}_pieces"), F.col(f"_{kind}_matches")) for kind in KINDS})
    value = lambda m: F.length(F.regexp_replace(m, VALUE, ""))
    kept = {"assign": F.filter("_assign", lambda s: value(s["match"]) >= 6), "access": F.filter("_access", lambda s: s["end"] - s["start"] >= 20)}
    out = out.withColumns({f"_{kind}": spans for kind, spans in kept.items()})
    base = F.concat("_assign", "_access", "_hex")
    random = F.filter("_markov", lambda s: (likelihood_ratio(s["match"], table) >= threshold) & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    out = out.withColumn("_markov", random)
    each = [F.transform(f"_{kind}", _ordered(k)) for k, kind in enumerate(KINDS)]
    kinds = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.transform(F.array_sort(F.concat(*each)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(kinds, s["order"]).alias("kind"), s["match"].alias("match")))
    return out.select(*columns, ordered.alias("secrets"))


def _ordered(order: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), s["match"].alias("match"))


def redact(found: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replace the union of each text's secrets (of ``scan``) by a mark; texts without any stay as they are."""
    kind = "struct<at:int,out:array<string>>"

    def add(have: Column, s: Column) -> Column:
        before = F.when(s["start"] >= have["at"], F.array(F.substring(F.col(text), have["at"] + 1, s["start"] - have["at"]), F.lit(mark))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(have["at"], s["end"]).alias("at"), F.concat(have["out"], before).alias("out")).cast(kind)

    done = F.aggregate("secrets", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")).cast(kind), add)
    whole = F.concat(F.array_join(done["out"], ""), F.substring(F.col(text), done["at"] + 1, F.length(text)))
    return found.withColumn(text, F.when(F.size("secrets") > 0, whole).otherwise(F.col(text)))
