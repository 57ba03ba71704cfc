"""Secret scans with a random forest against false findings, with DataFrame and ML functions alone.

Rules find candidates: known key formats, values assigned to names like password or token, and long mixed strings. For
each, the forest sees its length, its transitions between lower case, upper case and digits, its kinds of characters,
how much of it a dictionary covers (the commonest words of all documents), whether it is part of a path or address, and
the words beside it. It is trained on labelled findings (rule, value, before, after, label), at most MAX_LABELLED of them.
Without a table of one's own, sample_findings() makes them from a seed: some 30 families of keys and passwords in the usual
formats against identifiers, hashes, paths, numbers, placeholders and words.

Every finding is returned, with the probability of being a secret and the verdict. Null text is empty; ids may be null
or repeated; empty tables give no rows; texts and values of any length are whole. Matches of one rule don't overlap; a span that several rules find is one
finding, with the first rule's name.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, text_or_empty
from .spans import after, before, spans

MAX_LABELLED = 20_000
#: Words of the dictionary that are taken from the documents, the commonest of LEAST_LETTERS letters or more.
DICTIONARY, LEAST_LETTERS = 2000, 3
TREES, DEPTH, SEED = 40, 6, 7
THRESHOLD = 0.5
AROUND = 40

# Rules in order of preference, words of the dictionary and of the neighbourhood.
RULES = (
    ("aws_key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])"),
    ("github_token", r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22,}+)"),
    ("slack_token", r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}+"),
    ("google_key", r"(?<![A-Za-z0-9])AIza[0-9A-Za-z_-]{35}"),
    ("json_web_token", r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    ("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    ("assigned", r"(?<=[=:]|[=:][\x20\"']|[=:][\x20][\"'])[^\s\"'=:,;<>(){}]{8,}+"),
    ("mixed", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+"),
)
NAMES = r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|bearer|private)"
INNOCENT = r"(?i)(?:sha-?[0-9]*|md5|commit|checksum|digest|hash|uuid|guid|revision|version|file|image|path|href|src|url|id|isbn|example|sample|test)"
WORDS = "the|and|for|are|with|that|this|from|user|name|test|example|sample|default|admin|data|file|image|path|index|main|class|value|config|number|string|model|page|home|http|https|www|com|org|html|json|type|list|item|time|date|version|change|content|static|public|message|service|client|server|project|your|here|password|token|secret|key".split("|")
FEATURES = ("f_length", "f_switches", "f_kinds", "f_digits", "f_variety", "f_hex", "f_vowels", "f_words", "f_path", "f_named", "f_innocent", "f_assigned", "f_known")


def dictionary(docs: DataFrame, size: int = DICTIONARY, text: str = "text") -> list[str]:
    """The commonest words of all documents, at most size of them, and the fixed ones."""
    words = docs.select(F.explode(F.split(F.lower(text_or_empty(text)), "[^a-z]+")).alias("w")).where(F.length("w") >= LEAST_LETTERS)
    found = words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(size).collect()
    return sorted({*WORDS, *(r["w"] for r in found)})


def featured(found: DataFrame, words: list[str]) -> DataFrame:
    """found (rule, value, before, after, ...) with the forest's features; words: the dictionary."""
    v, b, a = F.col("value"), F.col("before"), F.col("after")
    n = F.greatest(F.length(v), F.lit(1))
    share = lambda pattern: F.regexp_count(v, F.lit(pattern)) / n
    known = [name for name, _ in RULES[:6]]
    parts = F.split(F.lower(F.regexp_replace(v, "([a-z])([A-Z])", "$1 $2")), "[^a-z]+")
    named = F.aggregate(F.filter(parts, lambda p: p.isin(words)), F.lit(0), lambda size, p: size + F.length(p))
    columns = {
        "f_length": F.length(v).cast("double"),
        "f_switches": share("[a-z](?=[A-Z0-9])|[A-Z](?=[a-z0-9])|[0-9](?=[A-Za-z])"),
        "f_kinds": sum((v.rlike(p).cast("double") for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")), F.lit(0.0)),
        "f_digits": share("[0-9]"),
        "f_variety": F.size(F.array_distinct(F.split(v, ""))) / F.least(n, F.lit(64)),
        "f_hex": v.rlike("^(?:[0-9a-f-]+|[0-9A-F-]+)$").cast("double"),
        "f_vowels": share("[aeiouAEIOU]"),
        "f_words": named / n,
        "f_path": (v.rlike(r"/.*/|\\|\.[a-z]{2,4}$") | b.rlike(r"(?:https?:|www\.|[/\\])[^\s]*$")).cast("double"),
        "f_named": b.rlike(NAMES + r"[A-Za-z_-]{0,20}[\"']?\s{0,3}(?:[=:]|is)?\s{0,3}[\"']?$").cast("double"),
        "f_innocent": (b.rlike(INNOCENT + r"[\"']?\s{0,3}(?:[=:]|is)?\s{0,3}[\"']?$") | a.rlike(r"^[\"']?\s{0,3}\.(?:png|jpg|gif|js|css|html)")).cast("double"),
        "f_assigned": b.rlike(r"[=:]\s?[\"']?$").cast("double"),
        "f_known": F.col("rule").isin(known).cast("double"),
    }
    return found.withColumns({k: F.coalesce(c.cast("double"), F.lit(0.0)) for k, c in columns.items()})


def findings(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, rule, start, end, value, before, after): every candidate of every row."""
    t = F.col("t")
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text).alias("t"))
    might = {"aws_key": t.contains("AKIA") | t.contains("ASIA"), "github_token": t.contains("gh") | t.contains("github_pat_"), "slack_token": t.contains("xox"), "google_key": t.contains("AIza"), "json_web_token": t.contains("eyJ"), "private_key": t.contains("PRIVATE KEY")}
    rows = base.select("doc_id", "t", *[spans(t, p, might.get(name)).alias(name) for name, p in RULES])

    def apart(own: Column, other: Column) -> Column:
        return F.filter(own, lambda m: ~F.exists(other, lambda x: (x["start"] < m["end"]) & (m["start"] < x["end"])))

    def named(k: int, name: str) -> Column:
        earlier = [F.col(other) for other, _ in RULES[:k]]
        own = F.col(name)
        if name == "assigned":
            own = F.filter(own, lambda m: before(t, m["start"], AROUND).rlike(NAMES + r"[A-Za-z_-]{0,20}[\"']?\s{0,3}[=:]\s?[\"']?$"))
        for other in earlier:
            own = apart(own, other)
        return F.transform(own, lambda m: F.struct(F.lit(name).alias("rule"), m["start"].cast("bigint").alias("start"), m["end"].cast("bigint").alias("end"), m["value"].alias("value"), before(t, m["start"], AROUND).alias("before"), after(t, m["end"], AROUND).alias("after")))

    return rows.select("doc_id", F.explode(F.concat(*[named(k, name) for k, (name, _) in enumerate(RULES)])).alias("f")).select("doc_id", "f.*")


def sample_findings(spark: SparkSession, n: int = 9000, words: list[str] = WORDS) -> DataFrame:
    """n labelled findings from a fixed seed: (rule, value, before, after, label, family). A family is one form of findings, so
    that a model can be tested on forms that it has not seen."""
    h = lambda k: F.sha2(F.concat(F.lit(f"{SEED}-{k}-"), F.col("id").cast("string")), 256)
    word = lambda k: F.get(F.array(*[F.lit(w) for w in words]), F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(len(words))).cast("int"))
    mixed = lambda k: F.regexp_replace(F.base64(F.unhex(h(k))), "[+/=]", "x")
    part = lambda c, size: F.substring(c, 1, size)
    digits = lambda k, size: part(F.translate(h(k), "abcdef", "012345"), size)
    letters = lambda k, size: part(F.translate(h(k), "0123456789abcdef", "aeioutnrshldcmfy"), size)
    text = F.lit
    kinds = [
        (1, "aws_key", F.concat(text("AKIA"), part(F.upper(mixed(2)), 16)), " ", " "),
        (1, "github_token", F.concat(text("ghp_"), part(mixed(2), 36)), "token: ", " "),
        (1, "slack_token", F.concat(text("xoxb-"), digits(3, 12), text("-"), part(mixed(2), 24)), "SLACK_TOKEN=", "\n"),
        (1, "google_key", F.concat(text("AIza"), part(mixed(2), 35)), "key=", "&"),
        (1, "json_web_token", F.concat(text("eyJ"), part(mixed(2), 30), text("."), text("eyJ"), part(mixed(4), 40), text("."), part(mixed(5), 40)), "Bearer ", "\n"),
        (1, "assigned", part(h(4), 18), "the password=", " the"),
        (1, "assigned", part(h(5), 40), ' token = "', '" and'),
        (1, "assigned", part(mixed(2), 20), "api_key: '", "'"),
        (1, "assigned", F.concat(letters(6, 4), text("!"), digits(7, 3), text("#"), letters(8, 5)), "passwd: ", " for"),
        (1, "assigned", F.concat(F.initcap(word(1)), digits(7, 4), text("$"), part(mixed(2), 4)), "db_password=", "\n"),
        (1, "mixed", part(mixed(2), 40), " secret ", " "),
        (1, "mixed", F.concat(part(mixed(2), 30), part(mixed(4), 34)), "access key is ", "."),
        (1, "mixed", F.concat(text("sk_live_"), part(mixed(2), 24)), "auth ", ","),
        (1, "mixed", part(h(5), 32), "api-key ", " in"),
        (0, "mixed", part(h(6), 40), "in commit ", " we"),
        (0, "mixed", h(7), "sha256: ", "\n"),
        (0, "mixed", F.concat_ws("-", part(h(8), 8), part(h(9), 4), part(h(10), 4), part(h(11), 4), part(h(12), 12)), "id ", " of"),
        (0, "mixed", part(h(6), 32), "md5 ", " of the file"),
        (0, "mixed", F.concat(text("static/image/"), word(1), text("/"), letters(8, 24), digits(3, 3)), "https://www.site.org/", ".png"),
        (0, "mixed", F.concat(word(1), text("/"), word(2), text("-"), word(3), text("-"), word(4), text("/"), digits(3, 6)), "see https://", "/"),
        (0, "mixed", F.concat(letters(8, 24), digits(3, 2)), " the word ", " is"),
        (0, "mixed", F.concat_ws("-", word(1), word(2), word(3), word(4), word(5), digits(3, 2)), " the page ", " is"),
        (0, "mixed", F.concat(text("IMG_"), digits(3, 8), text("_"), digits(4, 6), text("_"), word(1)), "file ", ".jpg"),
        (0, "mixed", F.concat(word(1), text("Config"), F.initcap(word(2)), text("Number"), digits(3, 2), F.initcap(word(3))), " class ", "("),
        (0, "mixed", F.concat(digits(3, 20), text("a")), "order ", " "),
        (0, "mixed", F.concat(digits(3, 8), text("T"), digits(4, 6), text("Z-"), digits(5, 8)), "at ", " the"),
        (0, "assigned", F.concat(word(1), text("_example_"), word(2)), "password: ", " "),
        (0, "assigned", F.concat(text("your_"), word(1), text("_here")), "token = ", "\n"),
        (0, "assigned", F.concat(word(1), word(2)), "password: ", " and"),
        (0, "assigned", text("********"), "password=", " "),
        (0, "assigned", F.concat(text("$"), F.upper(word(1)), text("_"), F.upper(word(2))), "secret=", "\n"),
    ]
    which = F.pmod("id", F.lit(len(kinds)))
    pick = lambda j: F.get(F.array(*[k[j] if isinstance(k[j], Column) else F.lit(k[j]) for k in kinds]), which.cast("int"))
    return spark.range(0, n, 1, 4).select(*[pick(j).alias(name) for j, name in ((1, "rule"), (2, "value"), (3, "before"), (4, "after"), (0, "label"))], which.cast("int").alias("family"))


def trained(labelled: DataFrame, words: list[str] = WORDS) -> RandomForestClassificationModel:
    """The forest from labelled findings (rule, value, before, after, label), at most MAX_LABELLED of them."""
    rows = featured(labelled.limit(MAX_LABELLED), words).select(*FEATURES, F.col("label").cast("double").alias("label"))
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return forest.fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows))


def scored(found: DataFrame, model: RandomForestClassificationModel, words: list[str] = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """found with probability and is_secret."""
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(featured(found, words))
    rows = model.transform(rows).withColumn("probability", F.round(vector_to_array("probability")[1], 6))
    return rows.withColumn("is_secret", F.col("probability") >= threshold).select(*found.columns, "probability", "is_secret")


def secrets(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, rule, start, end, value, before, after, probability, is_secret) of every finding."""
    words = dictionary(docs)
    model = trained(sample_findings(docs.sparkSession, words=words) if labelled is None else labelled, words)
    return scored(cut(findings(docs), "secret-findings"), model, words, threshold)
