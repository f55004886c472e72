import os

from evigraph.llm import lines, simhash
from evigraph.llm.common import connected_components, stored


def _watched(monkeypatch, module):
    """Rows of each table of rest pairs, and how many of them stand at once."""
    rows, paths, most = [], [], []
    write = lines.stored

    def watch(df, kind):
        table = write(df, kind)
        if kind == "rest_pairs":
            rows.append(table.count())
            paths.append(table._stored_at.removeprefix("file:"))
            most.append(sum(map(os.path.exists, paths)))
        return table

    monkeypatch.setattr(lines, "stored", watch)
    return rows, most


def test_parts_hold_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(lines, "REST_PART", 400)
    monkeypatch.setattr(lines, "REST_PLACES", 0)
    ids = [(h << lines.SIZE_BITS) + 1000 + 3 * h for h in range(40)]
    places = stored(spark.createDataFrame([(k, i) for k in (1, 2) for i in ids], "k long, id long"), "places")
    members = connected_components(spark.createDataFrame([(ids[0], ids[5])], "a long, b long"), "a", "b")
    held, parts = lines.rest_places(places, members)
    got = [[tuple(r) for r in lines.rest_part(held, 0.8, parts, part).collect()] for part in range(parts)]
    every = [p for part in got for p in part]
    wanted = {(a, b) for a in ids for b in ids if a < b and b % 4096 - a % 4096 <= 58 and (a, b) != (ids[0], ids[5])}
    assert parts == 4 and len(every) == len(set(every)) and set(every) == wanted
    assert max(map(len, got)) < len(every) / 2


def test_lines_of_a_frequent_key_are_compared_in_parts(spark, monkeypatch):
    rows = [(i, f"the same old passage stands in every line {chr(97 + i % 26) * 9}{chr(97 + i // 26) * 9} " + " ".join(f"{chr(97 + (i * j) % 23) * 3}{chr(97 + (i + j) % 19) * 5}" for j in range(5))) for i in range(80)]
    rows += [(1000 + i, t[:-1]) for i, t in rows[::9]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, lines.dedup_lines(docs).collect()))
    monkeypatch.setattr(lines, "REST_PART", 15_000)
    monkeypatch.setattr(lines, "REST_PLACES", 0)
    made, most = _watched(monkeypatch, lines)
    assert sorted(map(tuple, lines.dedup_lines(docs).collect())) == whole
    print(len(made), made)
    assert len(made) > 1 and max(made) < sum(made) and max(most) == 1
    assert {r[0] for r in whole if r[-1]} >= {1000 + i for i, _ in rows[:80:9]}


def test_near_copies_compare_a_frequent_key_in_parts(spark, monkeypatch):
    head = " ".join(f"word{i}" for i in range(30))
    rows = [(i, head + " " + " ".join(f"own{i}x{j}" for j in range(40 + i % 3))) for i in range(40)]
    docs = spark.createDataFrame([*rows, (100, rows[3][1] + " more")], "doc_id long, text string")
    monkeypatch.setattr(simhash, "SMALLEST", 40)
    monkeypatch.setattr(lines, "REST_PART", 8_000)
    monkeypatch.setattr(lines, "REST_PLACES", 0)
    made, most = _watched(monkeypatch, simhash)
    assert {r.doc_id for r in simhash.near_copies(docs).collect()} == set(range(40))
    assert len(made) > 1 and max(most) == 1
