from __future__ import annotations

import random

import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    """A shared folder of the tests' own where none is set in their session."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


def make_texts(seed: int = 5) -> list[str | None]:
    """Texts with copies, near copies, shared passages, runs, long ones, blanks and nulls."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["The", "of", "and", "été", "x y".split()[0]]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = text(60), text(120)
    near = []
    for i in range(8):
        w = base.split()
        w[10 * i + 3] = f"edit{i}"
        near.append(" ".join(w))
    lines = [text(6) for _ in range(5)]
    return [
        base, base, *near, text(40), text(40) + " " + passage, passage + " " + text(30), text(10) + "\n" + passage + "\n" + text(5),
        "run " * 70, "run " * 45 + text(10), "\n".join(lines), "\n".join(["head", *lines, "tail"]), "\n".join(lines[:2] + ["between"] + lines[2:]),
        text(3), text(3), "one two three", "One TWO three", "", "  \n\t ", None, None, text(2500), "a\u00a0b c", "é" * 50, passage.upper(), "\n\n".join(lines),
    ]


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with an extra column, clashing names, one row twice and one without an id."""
    rows = [(i, t, "l", f"src{i % 2}", len(t or ""), 7, -1) for i, t in enumerate(texts)]
    rows += [rows[0], (None, texts[0], "l", "s", 1, 7, -1), (None, None, "l", "s", 1, 7, -1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id int, n_removed int"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
