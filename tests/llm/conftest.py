import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, block string, size int"


@pytest.fixture(scope="session")
def corpus(spark):
    """A small corpus with nulls, empty and long texts, copies, near copies, repeated rows, and columns of clashing names."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abdeilnorstuü") for _ in range(rng.randint(2, 7))) for _ in range(300)]

    def line(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."

    texts = ["\n".join(line(rng.randint(5, 14)) for _ in range(rng.randint(2, 7))) for _ in range(60)]
    texts += [texts[0], texts[0], texts[1][:-2] + "x.", texts[2] + " extra", None, "", "  \n \t", "One two", "!!", " ".join(line(12) for _ in range(400))]
    texts += [texts[3].split("\n")[0] + "\n" + line(9), texts[4].split("\n")[0].replace("e", "i", 1) + "\n" + line(9), "中文 字 don't <|endoftext|> ÉTÉ ΑΣ"]
    rows = [(i, t, ["en", "de", None][i % 3], [f"s{i % 4}", "hot", None][min(i % 5, 2)], None, 1.0, "b", 7) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, texts[6], "en", None, None, 0.0, "b", 7), (None, None, None, None, None, 0.0, "b", 7), (7, "Another text of this key", "de", "s1", None, 0.0, "b", 7)]
    return spark.createDataFrame(rows, SCHEMA), rows


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
