"""Documents for the tests of the training-data operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that an operator might use for itself.
CLASHING = ["size", "target", "taken", "copies", "source_size", "key", "id", "score", "kept", "block", "n_words", "n_lines", "component", "component_id", "node", "lines", "sequence_id", "pattern", "quality", "toxic"]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


WORDS = [a + b + c for a in ("ka", "lo", "mi", "ter", "San") for b in ("ru", "ne", "vo", "dis") for c in ("", "n", "st", "é", "日")]


def corpus(seed=5, n=60):
    """(doc_id, text) with nulls, empties, blanks, exact and near copies, shared passages, repeated lines, other scripts and one long text."""
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        texts.append("\n".join(sentence(rng, rng.randint(1, 30)) for _ in range(rng.randint(1, 8))))
    passage, line = sentence(rng, 60), "The weather in 2024 was fine over the whole coast and the hills"
    texts[5] = texts[4]
    for k, drop in ((7, 3), (8, 5), (9, 60)):
        w = sentence(rng, 80).split() if k == 7 else texts[7].split()
        texts[k] = " ".join(w[:drop] + ["changed"] + w[drop + 1 :]) if k > 7 else " ".join(w)
    for k in (12, 13, 14):
        texts[k] = f"{texts[k]} {passage} {sentence(rng, 5)}"
    for k, edit in ((20, ""), (21, "!"), (22, "s"), (23, "")):
        texts[k] += "\n" + line.replace("2024", str(2000 + k)) + edit
    notice = " ".join(f"{sentence(rng, 9)} clause {k}" for k in range(40))
    for k, edit in ((20, ""), (21, "!"), (22, "s"), (23, " indeed")):  # so long that an edit hardly turns the hash
        texts[k] += "\n" + notice + edit
    texts[25] = "again and again and again and again and again"
    texts[26] = "\n".join(["the same line every time " * 2] * 12)
    texts[30], texts[31], texts[32], texts[33] = None, "", " \t\n\r ", "one"
    texts[34], texts[35] = "two words", "TWO  words"
    texts[36] = "#*$%&|<> " * 30
    texts[37] = "long " + " ".join(f"w{i % 977}" for i in range(20_000)) + " end"
    texts[38] = "日本語のテキスト 🙂🙂 é é İstanbul ǅ  nbsp em"
    return list(enumerate(texts, 1))
