import random

from graphloom.llm.decontaminate import Finder, distance_within, drop_contaminated, find_items, normal


def brute_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        now = [i]
        for j, t in enumerate(text, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (p != t)))
        row = now
    return min(row)


def edited(rng, data, edits):
    out = bytearray(data)
    for _ in range(edits):
        k = rng.randrange(len(out))
        out[k : k + rng.randint(0, 1)] = bytes([rng.choice(b"abcde ")] * rng.randint(0, 1))
    return bytes(out)


def items(rng, n=12):
    return [(i, " ".join("".join(rng.choice("aeiounrst") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(10, 40))).encode()) for i in range(n)]


def test_myers():
    rng = random.Random(1)
    for _ in range(60):
        p, t = (bytes(rng.choice(b"abc") for _ in range(rng.randint(1, n))) for n in (20, 60))
        found = distance_within(p, t, len(p))
        assert found is None or found[0] == brute_distance(p, t)
        assert found is not None or brute_distance(p, t) == len(p)


def test_no_match_is_lost():
    rng = random.Random(2)
    every = items(rng)
    texts = []
    for _ in range(120):
        _, p = rng.choice(every)
        texts.append(normal(b" ".join((rng.choice(every)[1][:30], edited(rng, p, rng.randint(0, len(p) // 8)), rng.choice(every)[1][5:40]))))
    for text, got in zip(texts, Finder(every).find(texts), strict=True):
        want = [(i, d) for i, p in every if (d := brute_distance(p, text)) <= int(0.1 * len(p))]
        assert [(i, e) for i, e, *_ in got] == want


def test_tables(spark, make, odd):
    rng = random.Random(3)
    bench = spark.createDataFrame([(i, p.decode()) for i, p in items(rng)] + [(50, None), (None, "x" * 60), (51, "too short"), (52, "")], "item_id long, text string")
    first, second = (r.text for r in bench.orderBy("item_id").where("item_id IN (0, 1)").collect())
    docs = make([*odd, (20, "Before. " + first.upper() + " after"), (21, first + "\n" + second), (22, "clean text, not much of it; too shorty"), (23, "that is TOO  short!")])
    for block in (1 << 20, 64):  # one pass, and many
        got = {r.doc_id: sorted(r.item_ids) for r in find_items(docs, bench, block_bytes=block).collect()}
        short = {r.doc_id: r.short_ids for r in find_items(docs, bench, block_bytes=block).collect()}
        assert short[23] == [51] and not any(v for k, v in short.items() if k != 23)
        assert got[20] == [0] and got[21] == [0, 1] and not any(v for k, v in got.items() if k not in (20, 21))
        kept = drop_contaminated(docs, bench, block_bytes=block)
        assert kept.columns == docs.columns and kept.count() == docs.count() - 2
    none = bench.where("item_id > 90")
    assert find_items(docs, none).where("size(item_ids) > 0").count() == 0 and drop_contaminated(docs, none).count() == docs.count()
    assert find_items(make([]), bench).count() == 0


def test_edited_items_at_the_start_of_later_texts():
    rng = random.Random(4)
    every = [(i, p[: rng.randint(40, 64)].strip()) for i, p in items(rng, 40) if len(p) > 64]
    texts = [p[rng.randint(1, int(0.1 * len(p))) :] + b" and so on" for _, p in every]
    want = [[(i, d) for i, p in every if (d := brute_distance(p, text)) <= int(0.1 * len(p))] for text in texts]
    assert all(want)
    for n in (1, len(texts)):  # each alone, and all in one step
        got = [x for k in range(0, len(texts), n) for x in Finder(every, least=1).find(texts[k : k + n])]
        assert [[(i, e) for i, e, *_ in own] for own in got] == want


def test_query_against_brute_force(spark, make, tmp_path):
    """The registered query, on a small table: every text against every item by dynamic programming."""
    from graphloom.llm.queries import QUERIES

    rng = random.Random(6)
    every = items(rng, 8)
    rows = []
    for k in range(60):
        _, p = rng.choice(every)
        parts = [rng.choice(every)[1][:25], edited(rng, p, rng.randint(0, len(p) // 7)), rng.choice(every)[1][3:30]]
        rng.shuffle(parts)
        rows.append((k, " ".join(x.decode() for x in parts[: rng.randint(1, 3)])))
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, p.decode()) for i, p in every], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: (r.contaminated, r.item_ids, r.edits) for r in QUERIES["op1_decontaminate"](spark, str(tmp_path)).collect()}
    for k, text in rows:
        want = [(i, d) for i, p in every if (d := brute_distance(p, normal(text.encode()))) <= int(0.1 * len(p))]
        assert got[k] == (bool(want), [i for i, _ in want], [d for _, d in want])
