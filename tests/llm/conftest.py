import random

import pytest

WORDS = [f"w{i}" for i in range(400)] + ["Été", "ünï", "das", "the", "日本語"]
SWAP = str.maketrans("ab", "ba")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, node long, h string, size double, run int, key string, bucket int, part int, text_crc32 long, shard string, mix_key int, _place long, component long"


def nasty_rows():
    """Documents with nulls, empties, repeats, near copies, shared passages, a long text and periodic text."""
    rng = random.Random(11)
    sentence = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    base, passage, line = sentence(120), sentence(70), sentence(14)
    texts = [base, base, base + " x1", base.replace("w1", "W1"), passage, f"{sentence(30)}\n{passage}\n{sentence(25)}", f"{sentence(40)} {passage} {sentence(9)}"]
    texts += [f"{line}\n{sentence(20)}\n{line}", f" {line.upper()} \n{sentence(12)}", f"{line} tail\n{sentence(12)}"]
    for k in range(40):  # a large group of near copies
        words = base.split(" ")
        for _ in range(k % 9):
            words[rng.randrange(len(words))] = f"e{k}"
        texts.append(" ".join(words))
    texts += ["", " ", "\n\n", "one", "one two", "ONE Two", "a" * 400, "a" * 300 + "b" + "a" * 300, "ab " * 200, "123 456 ###", "日本語 " * 60, sentence(3000), "-" * 49, "-" * 50, "-" * 50, None, None]
    texts += [sentence(rng.randrange(1, 60)) for _ in range(20)]
    morse = "a"
    while len(morse) < 2048:  # a Thue-Morse word and its complement collide in polynomials modulo 2**64
        morse += morse.translate(SWAP)
    texts += [morse, morse.translate(SWAP), f"{morse}\n{morse.translate(SWAP)}\n{morse}", " ".join(morse), " ".join(morse.translate(SWAP))]
    rows = []
    for i, t in enumerate(texts):
        rows.append((i * 3 + 1, t, ["en", "fr", None][i % 3], ["src0", "src0", "a", None, "B"][i % 5], None if i % 7 == 0 else i, *[None] * 14))
    rows += [rows[0], rows[5], rows[-1]]  # repeated rows
    rows += [(None, base, "en", "src0", 1, *[None] * 14), (None, passage, None, None, None, *[None] * 14), (rows[8][0], "same id another text " + sentence(60), "en", "a", 1, *[None] * 14)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def nasty(spark):
    return spark.createDataFrame(nasty_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nasty_texts():
    return [(r[0], r[1]) for r in nasty_rows()]


@pytest.fixture(scope="session")
def empty(nasty):
    return nasty.limit(0)
