"""Documents with every awkward case, and brute-force answers."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, z string, key string, tag string, bucket string, node string"


def documents(n: int = 120, seed: int = 3) -> list[tuple]:
    """Random prose with copies, shared passages, nulls, empty and repeated texts, ties, repeated ids, and columns with clashing names."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeéñßøç") for _ in range(rnd.randint(1, 8))) for _ in range(300)] + ["it's", "42", "x_y", "<|endoftext|>", "#!", "Ünï"]
    passage = " ".join(rnd.choice(words) for _ in range(40))
    prose = lambda k: " ".join(rnd.choice(words) + rnd.choice(["", "", "", ".", ",", "\n", "\t"]) for _ in range(k))
    texts: list[str | None] = [None, "", " \n\t ", "a", "aaaa " * 400, "a" * 3000, prose(5000), "É" * 60, "\x00\x1c\x85\xa0 b"]
    while len(texts) < n:
        t = prose(rnd.choice([2, 12, 13, 14, 60, 150]))
        kind = rnd.random()
        if kind < 0.3:
            cut = rnd.randint(0, len(t))
            t = t[:cut] + " " + passage[rnd.randint(0, 30) :] + " " + t[cut:]
        elif kind < 0.5 and texts[-1]:
            t = rnd.choice([x for x in texts if x])
            if rnd.random() < 0.5:
                t = t + " end"
        texts.append(t)
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    rows = [(i, t, rnd.choice(["en", "de", None]), "s", len(t or ""), "z", "k", "t", "b", "n") for i, t in zip(ids, texts)]
    return [*rows, rows[20], (rows[21][0], "another text under an id that is there already " * 3, "en", *rows[21][3:]), (None, texts[30], "en", "s", 1, "z", "k", "t", "b", "n"), (None, None, None, None, None, None, None, None, None, None)]


def repeats(rows: list[tuple], window: int, symbols) -> dict:
    """For every (id, text): the symbols and which of them go, by comparing all windows."""
    first: dict = {}
    data = [(r[0], r[1], symbols(r[1])) for r in rows]
    for i, _, s in data:
        if i is not None:
            for k in range(len(s) - window + 1):
                w = tuple(s[k : k + window])
                first[w] = min(i, first.get(w, i))
    out = {}
    for i, t, s in data:
        gone = [False] * len(s)
        if i is not None:
            for k in range(len(s) - window + 1):
                if first[tuple(s[k : k + window])] < i:
                    gone[k : k + window] = [True] * window
        out[(i, t)] = (s, gone)
    return out
