"""Plain versions of the operators on lists of rows, and small tables with awkward rows."""

from __future__ import annotations

import re
import zlib

LOWER = {code: code + 32 for code in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Columns whose names the operators use inside; they must not matter.
CLASHING = "key string, node long, words string, block int, hashes string, size int, start int, features string, row string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def documents(spark, texts, lang="en"):
    """Rows from (doc_id, text) pairs, with columns that clash."""
    rows = [(i, t, lang, "s", len(t) if t else None, "k", 1, "w", 2, "h", 3, 4, "f", "r") for i, t in texts]
    return spark.createDataFrame(rows, f"{DOCS}, {CLASHING}")


def shingle_set(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(found[at : at + 5]) for at in range(max(1, len(found) - 4))} if found else set()


def components(texts):
    """Smallest reachable id of each id, over all pairs."""
    sets = [(i, shingle_set(t)) for i, t in texts]
    low = {i: i for i, _ in sets}
    changed = True
    while changed:
        changed = False
        for i, one in sets:
            for j, two in sets:
                if one and two and low[i] != low[j] and 100 * len(one & two) >= 75 * len(one | two):
                    low[i] = low[j] = min(low[i], low[j])
                    changed = True
    return low


def hits(text, items, width=10):
    """Words of the text, hit words, and ids of the items with an occurring window."""
    own, hit, found = words(text), set(), set()
    for item, passage in items:
        theirs = words(passage)
        for at in range(max(1, len(theirs) - width + 1)) if theirs else ():
            window = theirs[at : at + width]
            for start in range(len(own) - len(window) + 1):
                if own[start : start + len(window)] == window:
                    hit.update(range(start, start + len(window)))
                    found.add(item)
    return len(own), len(hit), found


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
