"""Documents that hold every odd case, and words as the operators take them."""

import random
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text, fold=False):
    data = (text or "").encode()
    if fold:
        data = bytes(b + 32 if 65 <= b <= 90 else b for b in data)
    return WORD.findall(data)


def documents(n=60, seed=1):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghäé") for _ in range(r.randint(1, 7))) for _ in range(300)] + ["The", "of", "A", "x"]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 5, 30, 90]))) for _ in range(n)]
    passage = " ".join(r.choice(vocabulary) for _ in range(33))
    rows = []
    for k, t in enumerate(texts):
        if k % 6 == 0:
            t = t + " " + passage
        if k % 7 == 0 and k:
            t = texts[k - 1]
        if k % 11 == 0 and k:
            t = texts[k - 1] + " changed"
        rows.append((k * 3, t, "en", f"s{k % 4}" if k % 9 else None, len(t)))
    rows += [
        (1000, None, None, None, None), (1001, "", "en", "s0", 0), (1002, " \t\n ", "en", "s1", 4), (1003, "x", "en", "s2", 1), (None, "no id here at all", "en", "s0", 17),
        (1004, "a b", "en", "s1", 3), (1005, ("repeat after me please " * 600).strip(), "en", "s3", 0), (1006, " non breaking\x1fspace\x85 and İ ẞ Σς", "tr", "s2", 0),
        (1007, "wide " + "y" * 5000, "en", "s2", 0), (3, texts[1], "en", "s1", len(texts[1])), (3, texts[1], "en", "s1", len(texts[1])),
    ]
    return rows


def components(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]
