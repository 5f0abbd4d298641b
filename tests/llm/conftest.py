import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, tag string, node string, spans string, kept boolean, copies int"


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    parts = "an be ti or en re th on ing ed he at is it ly".split()
    return " ".join("".join(r.choices(parts, k=r.randint(1, 4))) for _ in range(words))


def rows() -> list[tuple]:
    base = prose(1, 300)
    passage = prose(2, 80)
    near = base.split()
    near[150] = "changed"
    texts = [
        (1, base), (2, base), (3, " ".join(near)), (4, prose(3, 120) + " " + passage + " " + prose(4, 60)), (5, prose(5, 50) + "\n" + passage),
        (6, None), (7, ""), (8, " \t\n"), (9, "one"), (10, "two words"), (None, prose(6, 90)), (11, prose(7, 4000)), (12, prose(8, 30)), (12, prose(8, 30)),
        (13, "word " * 200), (14, "x" * 3000), (15, "été 你好 \U0001f600 " * 40), (16, "a line\n\na line\nother\n a line"), (17, passage + " " + passage),
        (18, "Write to a.b@c.de or +1 (234) 555-6789, host 10.0.0.300 or 10.0.0.30; card 4111 1111 1111 1111. a@b@c.d e@f.g_h@i.j 1.2.3.4.5 call (555) 234-5678."),
        (19, "Released under the MIT License.\nCC-BY and the GNU General Public License; MIT license mit license"), (20, "Licensed under CC BY-NC 4.0.\nno"),
        (21, "<|endoftext|> and  two  spaces  x"), (22, "RIFF BM GIF89a ÿ"),
    ]
    langs, sources = ("en", None, "xx", "de"), ("s1", None, "s2", "S1", "s3")
    return [(d, t, langs[k % 4], sources[k % 5], None, k, "t", "n", "s", k % 2 == 0, 9) for k, (d, t) in enumerate(texts)]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)
