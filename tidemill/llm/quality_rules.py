"""Quality rules by line-first cleaning.

Every line with a word is tried against three rules. A line fails
* by punctuation, if it has under 4 words and doesn't end in terminal punctuation, or if over a tenth
  of the characters in its words are of # * $ % & | < >,
* by navigation, if it has two or more separators (| > » › • ·) and no terminal punctuation at its end,
  or if all its words are navigation words,
* by boilerplate, if it contains a boilerplate phrase. Words and phrases are English, German, French and Spanish.
Failing lines are removed. A document that loses over max_lost of the characters in its words is rejected,
and so is one that fails the base rules: under 50 words, or over half its words in repeated 3-word windows.

Null text counts as empty: no words, rejected. Repeated rows are judged one by one, null ids stay null,
other columns are left alone, and an empty table stays empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, text_or_empty

# Fixed values of the rules.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
TERMINAL = (".", "!", "?", ":", ";", '"', "'", ")", "”", "’", "»", "…", "。", "！", "？", "؟", "।")
SEPARATORS = ("|", ">", "»", "›", "•", "·")
NAVIGATION = (
    *("home", "about", "contact", "login", "logout", "register", "menu", "search", "next", "previous", "back", "top", "help", "faq", "sitemap", "share", "tweet", "print", "us", "sign", "in", "up", "more", "read"),
    *("startseite", "kontakt", "anmelden", "abmelden", "suche", "weiter", "hilfe", "teilen", "drucken", "mehr"),
    *("accueil", "connexion", "inscription", "recherche", "suivant", "retour", "aide", "partager", "imprimer", "plus"),
    *("inicio", "contacto", "acceder", "buscar", "siguiente", "anterior", "volver", "ayuda", "compartir", "imprimir"),
)
BOILERPLATE = (
    *("all rights reserved", "cookie", "privacy policy", "terms of use", "terms of service", "javascript", "lorem ipsum", "click here", "subscribe to our", "powered by", "skip to content", "copyright ©"),
    *("alle rechte vorbehalten", "hier klicken", "impressum", "nutzungsbedingungen"),
    *("tous droits", "cliquez ici", "politique de confidentialit", "conditions d'utilisation"),
    *("todos los derechos reservados", "haga clic", "aviso legal", "condiciones de uso"),
)
MIN_WORDS, SHORT_LINE, MAX_LOST = 50, 4, 0.4

COUNTS = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType())]
ADDED = [T.StructField(n, t) for n, t in COUNTS] + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("lost_chars", T.LongType()), T.StructField("clean_text", T.StringType())]


def line_fails(line: str) -> str | None:
    """The first rule that a line with a word fails, or None."""
    words = line.encode("utf-8", "surrogatepass").split()
    bare = line.strip(BLANKS)
    ended = bare.endswith(TERMINAL)
    symbols = sum(map(bare.count, SYMBOLS))
    low = b" ".join(words).lower().decode("utf-8", "surrogatepass")
    if sum(map(bare.count, SEPARATORS)) >= 2 and not ended or all(w in NAVIGATION for w in low.split(" ")):
        return "navigation"
    if 10 * symbols > word_chars(bare) or len(words) < SHORT_LINE and not ended:
        return "punctuation"
    return "boilerplate" if any(p in low for p in BOILERPLATE) else None


def word_chars(text: str) -> int:
    """Code points in words."""
    return len(text) - sum(map(text.count, BLANKS))


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text has twice or more, the first included."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=n)
    pairs = ids[:-1] * len(known) + ids[1:]
    if len(known) > 2_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(known) + ids[2:]
    _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = counts[which] > 1
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def measure(text: str, max_lost: float = MAX_LOST) -> tuple[int, int, int, int, int, bool, bool, int, str]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost characters, cleaned text."""
    words = text.encode("utf-8", "surrogatepass").split()
    chars, repeated = word_chars(text), repeat_words(words)
    seen: set[str] = set()
    stays, lost, copies = [], 0, 0
    for line in text.split("\n"):
        if not line.strip(BLANKS):
            stays.append(line)
            continue
        copies += line in seen
        seen.add(line)
        if line_fails(line):
            lost += word_chars(line)
        else:
            stays.append(line)
    failed = len(words) < MIN_WORDS or 100 * repeated > 50 * len(words)
    kept = not failed and lost <= max_lost * chars
    return len(words), chars, sum(map(text.count, SYMBOLS)), copies, repeated, failed, kept, lost, "\n".join(stays) if lost else text


def _rated(docs: DataFrame, max_lost: float, text: str) -> DataFrame:
    """(row, n_words, ..., clean_text): every row of docs as one struct, beside what the rules find."""
    small_batches(docs.sparkSession)
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_or_empty(text).alias("whole"))
    schema = T.StructType([df.schema["row"], *ADDED])
    types = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.int64(), pa.string()]

    def run(batches):
        for b in batches:
            rows = [measure(t, max_lost) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[k] for r in rows], type=t) for k, t in enumerate(types)]], names=schema.names)

    return df.mapInArrow(run, schema)


def assess(docs: DataFrame, max_lost: float = MAX_LOST, text: str = "text") -> DataFrame:
    """docs with the counts, base_failed, kept, lost_chars and clean_text beside every column it had.

    Columns of docs that clash with these names are replaced. An empty table stays empty; texts of any length are whole.
    """
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in {f.name for f in ADDED}]
    return _rated(docs, max_lost, text).select(*own, *[f.name for f in ADDED])


def clean(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """The documents that pass, without their failing lines, in the columns they had, whatever their names are; n_chars, if
    there, follows the text."""
    rated = _rated(docs, max_lost, "text").where("kept")
    new = {"text": F.col("clean_text")} | ({"n_chars": F.length("clean_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rated.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
