"""Small tables and plain restatements to hold the operators against."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def shingle_set(text):
    w = words((text or "").translate(SMALL))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(texts):
    """doc_id -> smallest doc_id reachable over links, by comparing all pairs."""
    ids = sorted(texts)
    sets = {i: shingle_set(texts[i]) for i in ids}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def corpus(n=60, seed=1):
    """doc_id -> text with copies, near copies, shared lines, odd white space, very long and very short texts."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéñß") for _ in range(r.randint(1, 9))) for _ in range(300)]
    line = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    shared = [line(12) for _ in range(4)]
    texts = {}
    for i in range(n):
        kind = r.random()
        if kind < 0.15 and texts:
            texts[i] = texts[r.choice(list(texts))]
        elif kind < 0.4 and texts:
            w = (texts[r.choice(list(texts))] or "x").split(" ")
            for _ in range(max(1, len(w) // 60)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            texts[i] = " ".join(w)
        else:
            texts[i] = "\n".join([line(r.randint(1, 40)) for _ in range(r.randint(1, 6))] + r.sample(shared, r.randint(0, 2)))
    texts[n] = None
    texts[n + 1] = ""
    texts[n + 2] = " \t\n\x0b"
    texts[n + 3] = "One two"
    texts[n + 4] = "\n".join(line(30) for _ in range(800))
    texts[n + 5] = "THE!! " * 30
    texts[n + 6] = "Straße x y <|endoftext|> é İ it's 12 ΣΑΣ don't\r\nend."
    return texts


def frame(spark, texts, **extra):
    rows = [(i, t, *(v for v in extra.values())) for i, t in texts.items()]
    columns = "doc_id long, text string" + "".join(f", `{c}` string" for c in extra)
    return spark.createDataFrame(rows, columns)


#: Columns whose names operators use themselves.
CLASHES = {"shard": "a", "id": "b", "key": "c", "label": "d", "n_lines": "e", "one": "f", "hashes": "g", "part": "h", "score": "i", "pii": "j", "_range": "k", "_row": "l", "source": "m"}
