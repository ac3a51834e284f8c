"""Small tables with the hard cases: nulls, empty texts, repeats, one very long text, other scripts."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, items string, line string, id long, places string"


def words(rng, n):
    return " ".join(rng.choice(["the", "Ação", "of", "über", "house", "42", "x1", "it's", "日本", "run", "Zu", "and"]) + rng.choice(["", "", ",", "."]) for _ in range(n))


def texts(seed=1):
    rng = random.Random(seed)
    base = [words(rng, 60) for _ in range(6)]
    out = [None, "", " ", "\n\n", "one", "two words", "\t\x0b\x0c\r ", "a" * 3000, "<|endoftext|> x <|endoftext|>", "é" * 50]
    for b in base:
        out += [b, b, b + " tail"]
        w = b.split(" ")
        for _ in range(4):
            v = list(w)
            for _ in range(rng.randint(1, 6)):
                v[rng.randrange(len(v))] = f"new{rng.randrange(1000)}"
            out.append(" ".join(v))
        out.append(words(rng, 10) + "\n" + b + "\n" + words(rng, 8))
        out.append(b.replace(" ", "\n", 7))
    out.append(words(rng, 3000))
    out.append(("spam ham " * 30).strip())
    lines = [words(rng, 9) for _ in range(5)]
    out.append("\n".join(lines + lines))
    out.append("\n".join(line + " more" for line in lines))
    out.append("\n".join("x " + line for line in lines[:2]) + "\n" + lines[3].replace("of", "off"))
    return out


def documents(spark, rows=None):
    """The texts with ids out of order, and columns whose names clash with those that operators make."""
    rows = texts() if rows is None else rows
    ids = list(range(len(rows)))
    random.Random(7).shuffle(ids)
    return spark.createDataFrame([(i, t, "en", "s", 0, -1, "i", "l", -5, "p") for i, t in zip(ids, rows, strict=True)], SCHEMA)


def as_dict(df):
    return {r["doc_id"]: r for r in df.collect()}
