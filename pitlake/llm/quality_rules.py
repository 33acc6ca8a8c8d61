"""Quality rules, line first: every line is judged, failing lines go, then documents that lost too much text go.

A line fails when it is symbol noise, a navigation row, shouting, word repetition, a run of words that ends without a mark, a boilerplate phrase
(English, French, German or Spanish) that fills at least half of a short line, or a repeat of an earlier line. Wrapped text, list items and headings over
prose are not taken for such runs. The base rules count words, symbols, repeated lines and repeated three-word windows of the whole text, and the text
that is left after lines went has to pass them as well.

Wrapped text: the line right after goes on in lower case or a script without case; or both stand in one paragraph (lines without an empty one between),
the next line's first word did not fit into the paragraph's width, and the paragraph comes to an end mark from there on.

Cases: a null text has no words and fails; the same holds for an empty one. Texts of any length are read whole, every line in a bounded number of passes.
Repeated rows are judged alike, an empty table gives an empty result, and other columns stay as they are in ``clean``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlake.llm.common import as_bytes, fresh, row_batches

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
NOT_SYMBOL = re.compile(r"[^#*$%&|<>]+")
# Phrases of page furniture in the four languages, matched in short lines only.
FOOTER = r"all rights reserved|tous droits réservés|alle rechte vorbehalten|todos los derechos reservados"
ENGLISH = (
    r"cookie (?:policy|settings)|accept (?:all )?cookies|enable javascript|privacy policy|terms of (?:use|service)|click here|read more|sign (?:in|up)|log ?in to"
    r"|subscribe to|share (?:this|on)|skip to (?:main )?content|powered by")
FRENCH = (
    r"politique de (?:confidentialité|cookies)|accepter (?:tous )?les cookies|paramètres des cookies|activez javascript|mentions légales|conditions (?:générales )?d['’]utilisation"
    r"|cliquez ici|lire la suite|en savoir plus|se connecter|connectez-vous|inscrivez-vous|abonnez-vous|partager (?:sur|cet article)|aller au contenu(?: principal)?")
GERMAN = (
    r"cookie-(?:richtlinie|einstellungen)|(?:alle )?cookies (?:akzeptieren|zulassen)|javascript aktivieren|datenschutzerklärung|nutzungsbedingungen|hier klicken|klicken sie hier"
    r"|weiterlesen|mehr (?:lesen|erfahren)|jetzt (?:anmelden|registrieren|abonnieren)|newsletter abonnieren|artikel teilen|teilen auf|zum (?:haupt)?inhalt springen")
SPANISH = (
    r"política de (?:privacidad|cookies)|aceptar (?:todas )?las cookies|configuración de cookies|habilite javascript|aviso legal|(?:términos|condiciones) de (?:uso|servicio)"
    r"|ha(?:ga|z) clic aquí|leer más|saber más|iniciar sesión|regístrate|suscríbete|compartir en|(?:saltar|ir) al contenido(?: principal)?")
BOILERPLATE = re.compile(rf"\b(?:{FOOTER}|{ENGLISH}|{FRENCH}|{GERMAN}|{SPANISH})\b", re.IGNORECASE)
WHOLE_LINE = re.compile(rf"\b(?:{FOOTER})\b", re.IGNORECASE)  # said nowhere but in footers: the rest of a short line is the owner's name
SEPARATORS = frozenset("| > » · • / ::".split())
LINE_END = re.compile(r"[.!?…:;。！？؟।][\"'”’»」』)\]*_]*\s*(?:\[\d+\]\s*)*$")
LOWER_START = re.compile(r"\s*[^\W\d_]")
INNER_END = re.compile(r"[.!?…。！？؟।][\"'”’»」』)\]*_]*(?:\s|$)")
LIST_ITEM = re.compile(r"\s*(?:[-–—*•·▪◦‣]|\(?(?:\d{1,3}|[A-Za-z])[.)])\s")

FEWEST_WORDS = 50
MOST_LOST = 0.5
SHORT_LINE_WORDS = 12
LEAST_JUDGED_WORDS = 5
RUN_ON_WORDS = 10
WRAPPED_CHARS = 50
HEADING_WORDS = 16


def separators(words: list[str]) -> int:
    """Separator words of a line; a bullet, quotation mark or slash that opens it and the » of a closed quotation are none."""
    quoted = "«" in words or any(w.startswith("«") for w in words)
    return sum(w in SEPARATORS and not (quoted and w == "»") and not (i == 0 and w != "|") for i, w in enumerate(words))


def continues(line: str, following: str) -> bool:
    """Whether a long line without an end mark is one of wrapped text: the line right after it goes on in lower case or a script without case."""
    start = LOWER_START.match(following)
    return len(line) >= WRAPPED_CHARS and start is not None and not start[0].strip().isupper() and not start[0].strip().istitle()


def wrapped_lines(lines: list[str]) -> list[bool]:
    """Per line: it fills its paragraph's width, so that the next line's first word had to move down, and an end mark follows in the paragraph.

    One pass forward finds the paragraphs and their widths, one backward whether a line leads to an end mark through full lines only.
    """
    out, start = [False] * len(lines), 0
    while start < len(lines):
        end = start
        while end < len(lines) and WORDS.search(lines[end]):
            end += 1
        width = max((len(line.rstrip()) for line in lines[start:end]), default=0)
        closed = end > start and INNER_END.search(lines[end - 1]) is not None
        for i in range(end - 2, start - 1, -1):
            word = WORDS.search(lines[i + 1])[0]
            out[i] = closed and width >= WRAPPED_CHARS and len(lines[i].rstrip()) + 1 + len(word) > width
            closed = INNER_END.search(lines[i]) is not None or out[i]
        start = end + 1
    return out


def heading(line: str, words: list[str], around: tuple[str, str], after: str) -> bool:
    """Whether a line that stands alone reads like a heading over prose: some words in capitals and some not, no sentence inside, and prose below.

    ``around`` are the lines right before and right after, both without words for a line that stands alone; ``after`` is the next line with words.
    """
    cased = [w[0].isupper() for w in words if w[0].isalpha()]
    return (len(words) <= HEADING_WORDS and bool(cased) and not any(map(WORDS.search, around)) and words[0][0].isupper() and not all(cased) and INNER_END.search(line) is None
            and len(WORDS.findall(after)) >= RUN_ON_WORDS and INNER_END.search(after) is not None)


def boilerplate(line: str, words: list[str]) -> bool:
    """Whether phrases of page furniture fill at least half of a short line; a footer's phrase needs no share."""
    if WHOLE_LINE.search(line):
        return True
    return 2 * sum(len(WORDS.findall(m[0])) for m in BOILERPLATE.finditer(line)) >= len(words)


def line_fails(line: str, words: list[str], following: str = "", exempt: bool = False) -> str | None:
    """Name of the first rule that a line with ``words`` fails, None if it passes.

    ``following`` is the line right after it; ``exempt`` says that its paragraph shows it to be wrapped text, or a heading.
    """
    n = len(words)
    if n <= SHORT_LINE_WORDS and BOILERPLATE.search(line) and boilerplate(line, words):
        return "boilerplate"
    # separators stand between the entries of a row: a short line needs an entry on both sides
    if not SEPARATORS.isdisjoint(words) and separators(words if n >= LEAST_JUDGED_WORDS else words[:-1]) * 5 >= n:
        return "navigation"
    if n < LEAST_JUDGED_WORDS:
        return None
    marks = len(NOT_SYMBOL.sub("", line))
    if marks and (marks * 10 >= len(line) or marks * 2 >= n):
        return "symbols"
    if line.count("!") * 3 >= n and line.upper() == line:
        return "shouting"
    if n >= 10 and len(set(words)) * 3 < n:
        return "repetition"
    if n >= RUN_ON_WORDS and not exempt and not LINE_END.search(line) and not continues(line, following) and not LIST_ITEM.match(line):
        return "punctuation"
    return None


def repeated_words(words: list[str]) -> int:
    """Words inside three-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered, reach = 0, 0
    for i, window in enumerate(windows):
        if window in often:
            covered += i + 3 - max(i, reach)
            reach = i + 3
    return covered


def next_with_words(lines: list[str]) -> list[str]:
    """Per line, the nearest later line with words, or an empty one."""
    out, found = [""] * len(lines), ""
    for i in range(len(lines) - 1, -1, -1):
        out[i] = found
        if WORDS.search(lines[i]):
            found = lines[i]
    return out


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < FEWEST_WORDS or 100 * n_repeat_words > 50 * n_words


def judge(text: str) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines_removed, n_words_removed, clean text)."""
    words = WORDS.findall(text)
    n, seen, dup_lines, removed, lost, stay = len(words), set(), 0, 0, 0, []
    lines = text.split("\n")
    wrapped, later = wrapped_lines(lines), next_with_words(lines)
    for i, line in enumerate(lines):
        own = WORDS.findall(line)
        if not own:
            stay.append(line)
            continue
        again = line in seen
        seen.add(line)
        dup_lines += again
        following = lines[i + 1] if i + 1 < len(lines) else ""
        if again or line_fails(line, own, following, wrapped[i] or heading(line, own, (lines[i - 1] if i else "", following), later[i])):
            removed += 1
            lost += len(own)
        else:
            stay.append(line)
    repeats = repeated_words(words)
    failed = base_fails(n, repeats)
    cleaned = "\n".join(stay) if removed else text
    kept = not failed and lost <= MOST_LOST * n and not (removed and base_fails(n - lost, repeated_words(WORDS.findall(cleaned))))
    return n, sum(map(len, words)), len(NOT_SYMBOL.sub("", text)), dup_lines, repeats, failed, kept, removed, lost, cleaned


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines_removed long, n_words_removed long"
TYPES = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2


def decoded(column: pa.Array) -> list[str]:
    return [b.decode("utf-8", "replace") for b in column.to_pylist()]


def judged(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept, and what the line rules took."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches):
            rows = [judge(t)[:9] for t in decoded(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), TYPES, strict=True)]], ["doc_id", *[f.split()[0] for f in FIELDS.split(", ")]])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", as_bytes("text")).mapInArrow(run, f"doc_id {kind}, {FIELDS}")


def clean(docs: DataFrame) -> DataFrame:
    """The documents that pass, without their failing lines; n_chars, where there is such a column, follows the text. A narrow map: no shuffle."""
    unique = [f"c{i}" for i in range(len(docs.columns))]
    (cleaned,) = fresh(unique, "cleaned")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches):
            names = batch.schema.names
            found = [judge(t) for t in decoded(batch.column(len(names) - 1))]
            kept = pa.array([f[6] for f in found], pa.bool_())
            out = pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([f[9] for f in found], pa.string())], names)
            yield out.filter(kept)

    fields = [T.StructField(u, f.dataType) for u, f in zip(unique, docs.schema.fields, strict=True) if f.name != "text"]
    plain = docs.select(*[F.col(f"`{c}`").alias(u) for u, c in zip(unique, docs.columns, strict=True) if c != "text"], as_bytes("text").alias(cleaned))
    kept = plain.mapInArrow(run, T.StructType([*fields, T.StructField(cleaned, T.StringType())]))
    out = []
    for u, field in zip(unique, docs.schema.fields, strict=True):
        value = F.col(cleaned) if field.name == "text" else F.length(cleaned) if field.name == "n_chars" else F.col(u)
        out.append(value.cast(field.dataType).alias(field.name))
    return kept.select(*out)
