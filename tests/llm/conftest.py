import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, w_row string, shard string"


def prose(rng, n, words=("the", "of", "and", "to", "in", "is")):
    syllables = "an er th on re st ed ou ing ble".split()
    return " ".join(rng.choice(words) if rng.random() < 0.4 else "".join(rng.choice(syllables) for _ in range(3)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty and long texts, repeats and near copies; extra columns have names the code uses."""
    rng = random.Random(7)
    base = [prose(rng, n) for n in (3, 12, 60, 200, 400, 3000)]
    passage = prose(rng, 45)
    near = base[4].split()
    near[7] = "changed"
    far = base[4].split()
    far[::9] = ["other"] * len(far[::9])
    texts = [*base, base[3], " ".join(near), " ".join(far), base[2] + "\n" + passage + "\n" + base[1], passage + " tail of it", None, "", " \t\n", "x", "é à ü", base[5], base[3].upper(), f"{passage}\n{passage}", "a\x0bb\x0cc\rd"]
    out = [(i, t, "en", f"s{i % 3}", 1, "r", "s") for i, t in enumerate(texts)]
    out.append(out[3])  # a repeated row
    out.append((100, base[0], None, None, None, None, None))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
