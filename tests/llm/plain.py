"""Plain versions of the operators, for small inputs, and inputs with odd rows."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import duckdb

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS = " \t\n\x0b\f\r"
SENTENCES = [
    "the river runs past the old mill and on towards the harbour where small boats wait for morning",
    "a committee of seven people read every letter that had come in since the beginning of the year",
    "nobody could say why the lamps along the northern road went out one after the other that night",
    "she kept the ledgers in a cupboard under the stairs together with maps of places she had never seen",
    "after the rain the fields smelled of earth and the children built a dam across the narrow ditch",
]
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "n_words string, kept string, doc string, hits string, row string, node string, root string"
)
SHARED = "This very line is long enough to be shared between documents."


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def paragraph(k: int, n: int = 5) -> str:
    """Prose of its own for every k."""
    parts = [f"{SENTENCES[(k + i) % 5]} {' '.join(f'{w}{k}x{i}' for w in ('stone', 'leaf', 'bell'))}." for i in range(n)]
    return "\n".join(parts)


def rows(ids: list) -> list[tuple]:
    """Texts under the given ids with further columns whose names clash with those used inside."""
    texts = [
        None, "", " \t\n", "word", "\n\n", "Über ßtraße ÄÖ é", "a b c", "a b c d", "A B\x0bC d", "* # $ % & | < > " * 9,
        "one two three four five six seven eight nine ten " * 12, "same line\nsame line\nsame line\n" * 4,
        *[f"{SHARED}\n{paragraph(k)}" for k in range(3)],
        *[f"  {SHARED.upper()}\t\n{paragraph(k + 3)}\n{SHARED}" for k in range(3)],
        paragraph(20), paragraph(20), paragraph(20) + " tail", paragraph(20).upper(), paragraph(21, 400),
        paragraph(22) + " " + "x" * 30_000, paragraph(23),
    ]
    return [
        (doc, texts[k % len(texts)], "en", None, None, "7", "no", "d", "h", "r", "n", "t") for k, doc in enumerate(ids)
    ]


def sql(statement: str, **frames) -> list[tuple]:
    db = duckdb.connect()
    for name, frame in frames.items():
        db.register(name, frame)
    cursor = db.execute(statement)
    names = [c[0] for c in cursor.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(repr(r[k]) for k in order) for r in cursor.fetchall())


def plain_rows(df) -> list[tuple]:
    names = sorted(df.columns)
    return sorted(tuple(repr(r[n]) for n in names) for r in df.collect())


def line_dedup(docs: dict[int, str | None]) -> dict[int, str]:
    where = defaultdict(set)
    key = lambda line: lower(line.strip(BLANKS))
    for doc, text in docs.items():
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                where[key(line)].add(doc)
    gone = {k: max(v) for k, v in where.items() if len(v) >= 5}
    return {
        doc: "\n".join(x for x in (text or "").split("\n") if gone.get(key(x), doc) == doc) for doc, text in docs.items()
    }


def shingle_set(text: str | None, width: int = 4) -> set:
    words = WORD.findall(lower(text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def jaccard_groups(docs: dict[int, str | None]) -> dict[int, int]:
    sets = {d: shingle_set(t) for d, t in docs.items()}
    root = {d: d for d in docs}
    ids = sorted(docs)
    changed = True
    links = [
        (a, b) for a in ids for b in ids
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ]
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


def smith_waterman(item: list[str], passage: list[str]) -> int:
    best, last = 0, [0] * (len(passage) + 1)
    for wanted in item:
        here = [0]
        for j, word in enumerate(passage, 1):
            here.append(max(0, last[j - 1] + (2 if word == wanted else -1), last[j] - 1, here[j - 1] - 1))
        best, last = max(best, *here), here
    return best


def leaking(docs: dict[int, str | None], items: dict[int, str]) -> set[tuple[int, int]]:
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    return {
        (d, i) for d, text in docs.items() for i, item in items.items()
        if len(words(item)) >= 4 and 4 * smith_waterman(words(item), words(text)) >= 2 * 2 * len(words(item))
    }


def good(text: str | None) -> bool:
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    n, chars = len(words), sum(map(len, words))
    windows = [tuple(words[i : i + 8]) for i in range(n - 7)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(8)}
    if n < 20 or 100 * len(covered) > 30 * n:
        return False
    return not (
        sum(text.count(c) for c in "#*$%&|<>") > 0.05 * chars
        or 10 * (len(lines) - len(set(lines))) > 3 * len(lines)
        or chars < 2 * n or chars > 15 * n
        or 20 * len(set(words)) < n
        or 10 * sum(a == b for a, b in zip(words, words[1:], strict=False)) > 3 * n
        or 2 * sum(c.isalpha() for c in text) < chars
    )
