"""Quality rules, line first: judge each line, take failing lines out, reject documents that lose too much."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SPACES, lean, words

# Fixed values of the rules.
SYMBOLS = "#*$%&|<>"
SENTENCE_MARKS = ".!?;:…。！？"
SEPARATORS = "|»›•"
NAVIGATION = (
    "home", "menu", "login", "log in", "sign in", "sign up", "register", "next", "previous", "back to top", "share", "skip to content", "read more", "search",
    "startseite", "menü", "anmelden", "registrieren", "weiter", "zurück", "nach oben", "teilen", "zum inhalt springen", "mehr lesen", "weiterlesen", "suche",
    "inicio", "menú", "iniciar sesión", "registrarse", "siguiente", "anterior", "volver arriba", "compartir", "saltar al contenido", "leer más", "buscar",
    "accueil", "connexion", "se connecter", "s’inscrire", "suivant", "précédent", "haut de page", "partager", "aller au contenu", "lire la suite", "rechercher",
)
BOILERPLATE = (
    "all rights reserved", "cookie policy", "accept cookies", "terms of use", "terms of service", "privacy policy", "click here", "enable javascript", "lorem ipsum", "licensed under", "subscribe to our newsletter",
    "alle rechte vorbehalten", "cookie-richtlinie", "cookies akzeptieren", "nutzungsbedingungen", "datenschutzerklärung", "hier klicken", "newsletter abonnieren",
    "todos los derechos reservados", "política de cookies", "aceptar cookies", "términos de uso", "política de privacidad", "haga clic aquí", "suscríbase a nuestro",
    "tous droits réservés", "politique de cookies", "accepter les cookies", "politique de confidentialité", "mentions légales", "cliquez ici", "abonnez-vous à notre",
)
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)))


@dataclass(frozen=True)
class Rules:
    """symbol_every: a line fails with more than one layout symbol (or '!!') in so many words.
    unmarked_words: a line of so many words fails without any sentence mark.
    separator_every: a line fails with more than one separator in so many words.
    lost_percent: a document is rejected if it loses more of its word characters."""

    min_words: int = 50
    repeat_percent: int = 50
    symbol_every: int = 5
    unmarked_words: int = 10
    separator_every: int = 3
    lost_percent: int = 30


def _count(text: str, characters: str) -> int:
    return sum(map(text.count, characters))


def line_fails(line: str, n_words: int, rules: Rules) -> str | None:
    """Name of the rule that a line with words fails."""
    if (_count(line, SYMBOLS) + line.count("!!")) * rules.symbol_every > n_words:
        return "punctuation"
    if n_words >= rules.unmarked_words and not any(c in line for c in SENTENCE_MARKS):
        return "punctuation"
    if _count(line, SEPARATORS) * rules.separator_every > n_words:
        return "navigation"
    low = line.lower()
    if low.strip(SPACES) in NAVIGATION:
        return "navigation"
    return "boilerplate" if _BOILERPLATE.search(low) else None


def repeat_words(ws: list[bytes]) -> int:
    """Words in 3-word windows that are found twice or more."""
    if len(ws) < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter([ids.setdefault(w, len(ids)) for w in ws], np.int64, len(ws))
    n = len(ids)
    pair = a[:-1] * n + a[1:]
    if n > 2_000_000:  # keep the code of a triple within 63 bits
        _, pair = np.unique(pair, return_inverse=True)
    _, at, times = np.unique(pair[:-1] * n + a[2:], return_inverse=True, return_counts=True)
    twice = times[at] > 1
    hit = np.zeros(len(ws), bool)
    for k in range(3):
        hit[k : k + len(twice)] |= twice
    return int(hit.sum())


def judge(text: str | None, rules: Rules = Rules()) -> dict:
    """All figures of a document, its verdict and its text without the failing lines."""
    text = text or ""
    ws = words(text)
    word_chars = len(text) - _count(text, SPACES)
    lines, seen, kept, lost = text.split("\n"), set(), [], 0
    fails = {"punctuation": 0, "navigation": 0, "boilerplate": 0}
    with_words = 0
    for line in lines:
        n = len(words(line))
        if n:
            with_words += 1
            seen.add(line)
            why = line_fails(line, n, rules)
            if why:
                fails[why] += 1
                lost += len(line) - _count(line, SPACES)
                continue
        kept.append(line)
    repeated = repeat_words(ws)
    base_failed = len(ws) < rules.min_words or 100 * repeated > rules.repeat_percent * len(ws)
    return {
        "n_words": len(ws), "word_chars": word_chars, "n_symbols": _count(text, SYMBOLS), "n_dup_lines": with_words - len(seen),
        "n_repeat_words": repeated, "base_failed": base_failed, "kept": not base_failed and 100 * lost <= rules.lost_percent * word_chars,
        "n_lines_failed": sum(fails.values()), "lost_chars": lost, "clean_text": "\n".join(kept),
    }


FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines_failed long, lost_chars long"
_LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines_failed", "lost_chars")


def quality_figures(docs: DataFrame, rules: Rules = Rules(), clean: bool = False) -> DataFrame:
    """doc_id and the figures of each row of docs (doc_id, text); with clean, also clean_text.

    A row for each input row: null and empty texts have no words and fail, repeated rows come
    repeatedly, a null doc_id stays null, no rows give no rows, other columns are not read.
    """
    names = [f.split()[0] for f in FIGURES.split(", ")] + ["clean_text"] * clean

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            rows = [judge(t, rules) for t in b.column(1).to_pylist()]
            cols = [pa.array([r[n] for r in rows], pa.string() if n == "clean_text" else pa.int64() if n in _LONGS else pa.bool_()) for n in names]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + FIGURES + ", clean_text string" * clean)


def clean_documents(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that are kept, without their failing lines; all columns stay, n_chars is counted anew if present.

    Rejected documents (null, empty and short texts among them) go; repeated rows are judged one by one.
    """
    schema = docs.schema
    at = schema.fieldNames().index("text")
    size = schema.fieldNames().index("n_chars") if "n_chars" in schema.fieldNames() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            rows = [judge(t, rules) for t in b.column(at).to_pylist()]
            keep = pa.array([r["kept"] for r in rows], pa.bool_())
            cols = list(b.columns)
            cols[at] = pa.array([r["clean_text"] for r in rows], pa.string())
            if size is not None:
                cols[size] = pa.array([len(r["clean_text"]) for r in rows], pa.int64()).cast(b.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(cols, b.schema.names).filter(keep)

    return docs.mapInArrow(run, schema)
