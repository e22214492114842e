import pytest

from filigree.llm.sharding import lookup_table, shard, shard_names


def brute(names, slots):
    import hashlib

    perms = []
    for n in names:
        h = hashlib.md5(n.encode()).digest()
        a, s = int.from_bytes(h[:8], "big") % slots, int.from_bytes(h[8:], "big") % (slots - 1) + 1
        perms.append([(a + j * s) % slots for j in range(slots)])
    table, nxt = {}, [0] * len(names)
    while len(table) < slots:
        for k, p in enumerate(perms):
            while p[nxt[k]] in table:
                nxt[k] += 1
            table[p[nxt[k]]] = k
            if len(table) == slots:
                break
    return [table[i] for i in range(slots)]


def test_table_is_that_of_the_permutations():
    assert lookup_table(shard_names(7), 101) == brute(shard_names(7), 101)


def test_even_and_little_disruption():
    names = shard_names(10)
    a, b = lookup_table(names, 8191), lookup_table(names[:-1], 8191)
    counts = [a.count(i) for i in range(10)]
    assert max(counts) - min(counts) <= 1
    assert sum(x != y for x, y in zip(a, b, strict=True) if x != 9) < 0.1 * 8191


@pytest.mark.parametrize("names,slots", [([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)])
def test_bad_parameters(names, slots):
    with pytest.raises(ValueError):
        lookup_table(names, slots)


def test_rows(docs, none):
    out = shard(docs).collect()
    assert len(out) == docs.count() and all(0 <= r.shard < 64 and 0 <= r.slot < 8191 for r in out)
    by = {}
    for r in out:
        assert by.setdefault(r.doc_id, r.shard) == r.shard
    assert shard(none).count() == 0 and shard(docs).columns.count("slot") == 1
    plan = shard(docs.select("doc_id"))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan and "Python" not in plan
