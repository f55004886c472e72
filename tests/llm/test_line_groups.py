import random

from tests.llm.test_line_recall import groups


def test_similar_lines_of_a_key_that_are_far_from_its_first_one(spark):
    rng = random.Random(9)
    texts = []
    for _ in range(24):
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 3))) for _ in range(30)]
        texts += [" ".join([*words[:15], "with", *words[15:]]), " ".join([*words[:15], "with", *words[15:29], "zz"])]
    group = groups(spark, texts)
    assert all(group[i] == group[i + 1] for i in range(0, len(texts), 2))
    assert len(set(group)) == len(texts) // 2
