"""Plain versions of the operators, and the table of odd cases that all of them must take."""

import collections
import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, shard int, label int"


def odd_rows(seed=1):
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows; columns named like the operators' own."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéßÀXYZ") for _ in range(rng.randint(1, 8)))
    text = lambda n: " ".join(word() + rng.choice(["", "", ".", ",\n"]) for _ in range(n))
    long = text(30_000)
    same = text(80)
    texts = [None, "", " \t\n\x0b\x0c\r ", "a", "a b c d", "###", "1234", "中文 字", same, same, same + " x", long, "x" * 50_000, "\x1c \x85  ", "<|endoftext|> y"]
    rows = [(i, t, ["en", "de", None, "xx"][i % 4], ["s1", "s2", None][i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(100 + i, text(rng.randint(5, 120)), rng.choice(["en", "de", "fr"]), rng.choice(["s1", "s2", "s3"]), 1) for i in range(40)]
    rows += [rows[20], rows[20], (None, "no id here at all", "en", "s1", 5), (None, None, None, None, None)]
    return [(*r, 0.5, True, 3, None) for r in rows]


def odd_table(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def empty_table(spark):
    return spark.createDataFrame([], SCHEMA)


SPACE = re.compile(r"[\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    text = (text or "").translate(LOWER) if lower else text or ""
    return [w for w in SPACE.split(text) if w]


def shingles(text, width=5):
    w = words(text, lower=True)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def near_duplicate_groups(rows, numerator, denominator):
    """{doc_id: (size, smallest id of its component)} of (doc_id, text)."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inverted[x].append(i)
    for i, s in sets.items():
        common = collections.Counter(j for x in s for j in inverted[x] if j < i)
        for j, n in common.items():
            if n * denominator >= (len(s) + len(sets[j]) - n) * numerator:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: (len(s), find(i)) for i, s in sets.items()}


def base_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = {x for x, n in collections.Counter(windows).items() if n > 1}
    covered = {i + k for i, x in enumerate(windows) if x in twice for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)
