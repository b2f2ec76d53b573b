"""Decision lists, conversation repair and the source audit against brute force, and their edge cases."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import decision_lists, queries, source_audit, trie_repair
from skein.llm.common import table
from skein.llm.quality_gbt import fold

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = " \t\n\x0b\f\r"

# --------------------------------------------------------------------------- decision lists


def plain_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words by the letter of the contract."""
    text = text or ""
    words = WORD.findall(text)
    seen, held, dup = {}, set(), 0
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            held |= {i + k for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(held)


TEXTS = [None, "", " \n \t", "one", "a b c a b c a", "x\nx\n \n \nx y\nx y", "é ü#*$\n%&|<>", "w " * 7, "a b c d\x0be\x85f g h", "😀 𝒳 ab", "long words repeat " * 20000, "A1! B2? c3."]


def test_counts_equal_brute_force():
    got = decision_lists.counts(TEXTS)
    for t, row in zip(TEXTS, got, strict=True):
        if t is None or len(t) < 10000:
            assert tuple(row[:5]) == plain_counts(t), t
    g = random.Random(5)
    more = [" ".join(g.choice(["a", "b", "c\n", "d ", "#e"]) for _ in range(g.randrange(60))) for _ in range(200)]
    for t, row in zip(more, decision_lists.counts(more), strict=True):
        assert tuple(row[:5]) == plain_counts(t), t
    assert decision_lists.counts(["long words repeat " * 20000])[0][4] == 60000


def test_learn_finds_planted_rules_and_decides_like_them():
    g = np.random.Generator(np.random.PCG64(3))
    x = g.random((6000, len(decision_lists.RATIOS)))
    bad = ((x[:, 1] > 0.9) & (x[:, 3] < 0.5)) | (x[:, 7] > 0.95)
    found = decision_lists.learn(x, bad)
    y = g.random((6000, x.shape[1]))
    want = ((y[:, 1] > 0.9) & (y[:, 3] < 0.5)) | (y[:, 7] > 0.95)
    assert len(found.rules) >= 2 and ((found.decide(y) > 0) == want).mean() > 0.99
    assert str(found).endswith("else keep")


def test_learn_leaves_noise_and_single_classes_alone():
    g = np.random.Generator(np.random.PCG64(4))
    x = g.random((2000, len(decision_lists.RATIOS)))
    assert decision_lists.learn(x, g.random(2000) < 0.1).rules == []
    for bad in (np.zeros(2000, bool), np.ones(2000, bool)):
        assert decision_lists.learn(x, bad).rules == []
    assert decision_lists.learn(x[:0], np.zeros(0, bool)).rules == []


def test_rules_as_spark_columns_decide_like_numpy(spark):
    stats = decision_lists.statistics(table(spark, SF, "documents"))
    C = decision_lists.Condition
    rules = decision_lists.DecisionList([(C(1, True, 0.05), C(0, False, 7.0)), (C(10, True, 0.02),)], [(0, 0), (0, 0)])
    rows = stats.select(*[decision_lists.ratio(a, b).alias(n) for n, a, b in decision_lists.RATIOS], rules.rule_column().alias("rule")).toPandas()
    got = rules.decide(rows[[n for n, _, _ in decision_lists.RATIOS]].to_numpy(float))
    assert (got == rows["rule"].to_numpy()).all() and len(set(got)) == 3


def test_quality_rules_hold_on_the_fold_not_learned(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    out = queries.op11_decision_lists(spark, sf).toPandas().set_index("doc_id")
    for r in docs.collect():
        o = out.loc[r.doc_id]
        base = plain_counts(r.text)
        assert tuple(o[["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]]) == base
        assert o.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0]) and not (o.kept and o.base_failed)
    held = labels.where(fold(F.col("doc_id")) == 0).toPandas().set_index("doc_id").join(out, how="inner")
    held = held[~held.base_failed]
    assert (held.kept == (held.quality == 1)).mean() > 0.95


def test_quality_rules_edges(spark):
    schema = "doc_id long, text string, id string, rule string, n_words string"
    docs = spark.createDataFrame([(i % 11 if i else None, t, "x", "y", "z") for i, t in enumerate(TEXTS)], schema)
    labels = spark.createDataFrame([(1, None), (None, 0), (2, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    out = decision_lists.quality_rules(docs, labels).collect()
    assert len(out) == len(TEXTS) and sum(r.doc_id is None for r in out) == 1
    assert sorted(r.n_words for r in out) == sorted(plain_counts(t)[0] for t in TEXTS)
    assert all(r.base_failed and not r.kept for r in out)
    assert decision_lists.quality_rules(docs.limit(0), labels).count() == 0
    good = " ".join(f"w{i}" for i in range(80)) + "."
    one = spark.createDataFrame([(5, good)], "doc_id long, text string")
    assert decision_lists.quality_rules(one, labels.limit(0)).first().kept


# --------------------------------------------------------------------------- conversations


def cheapest(items):
    """Best first over all edit sequences: (cost, audit, rows) of (role, fault) items; knows only costs and the role pattern."""
    legal = re.compile(r"(s?(ua)+)?")
    partial = re.compile(r"s?(ua)*u?")
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, out = heapq.heappop(heap)
        if i == len(items) and legal.fullmatch(roles):
            return cost, audit, out
        if (i, roles, audit) in done:
            continue
        done.add((i, roles, audit))
        nxt = []
        for c in "ua":
            nxt.append((cost + 3, audit + "I", i, roles + c, out + ((None, c),)))
        if i < len(items):
            role, fault = items[i]
            nxt.append((cost + 4, audit + "D", i + 1, roles, out))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                nxt.append((cost + more, audit + "K", i + 1, roles + (role[:1] or "?"), out + ((i, None),)))
                nxt += [(cost + 3 + more, audit + "R", i + 1, roles + c, out + ((i, c),)) for c in "ua"]
        for x in nxt:
            if partial.fullmatch(x[3]):
                heapq.heappush(heap, x)


def plain_repair(rows, damage=True):
    """conv_id to its digest, by brute force."""
    convs = {}
    one = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        role, text = one(role), one(text)
        how = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20 if damage else 9
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        own += [(turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        seen, items = set(), []
        for _, role, text in own:
            t = text.strip(BLANK)
            items.append((role, "blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else None))
            seen.add((role, text))
        cost, audit, made = cheapest(items)
        name = {"u": "user", "a": "assistant"}
        said = "\n".join(f"{name[c]}:" if i is None else f"{name.get(c) or own[i][1]}:{own[i][2]}" for i, c in made)
        turns = [r[0] for r in own if r[0] is not None]
        faults = [f for _, f in items]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest())
    return out


def random_conversations(n, seed):
    g = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(g.randrange(7)):
            rows.append((conv, None if g.random() < 0.05 else turn + g.randrange(2), g.choice(["user", "assistant", "system", "tool", None, "", "Ußer"]), g.choice(["Hello.", "Well", "a?", "b!\n ", "", None, " \t", "done.\x0b"])))
    return rows


CONV = "conv_id long, turn long, role string, text string"


def test_damaged_conversations_are_repaired_as_by_brute_force(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table(spark, SF, "conversations").collect()] + [(1000 + c, *r) for c, *r in random_conversations(300, 8)]
    rows += [(None, 0, "user", "No id."), (None, 1, "assistant", "No id.")]
    df = spark.createDataFrame(rows, CONV)
    got = {r.conv_id: tuple(r)[1:] for r in trie_repair.audit(trie_repair.damaged(df), dropped="dropped").collect()}
    assert got == plain_repair(rows)


def test_repair_edges(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Dropped.", "x", 1, "y")], CONV + ", key string, position int, hash string")
    out = trie_repair.audit(trie_repair.damaged(df), dropped="dropped").collect()
    assert [tuple(r) for r in out] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert trie_repair.audit(df.limit(0)).count() == 0
    rows = [(1, 0, "user", "Same."), (1, 0, "user", "Same."), (1, 0, "user", "Same."), (1, None, "system", "Long words. " * 20000)]
    r = trie_repair.audit(spark.createDataFrame(rows, CONV)).first()
    assert tuple(r)[1:] == plain_repair(rows, damage=False)[1] and r.audit == "KKDDI"


def test_repaired_rows_have_texts_and_edits(spark):
    df = spark.createDataFrame([(7, 0, "tool", "Hi"), (7, 1, "assistant", "Yes."), (7, 2, "user", "")], CONV)
    got = [tuple(r) for r in trie_repair.repaired(df).orderBy("position").collect()]
    assert got == [(7, 1, "R", "user", "Hi"), (7, 2, "K", "assistant", "Yes.")]


def test_prefixes_share_their_layers():
    g = random.Random(2)
    words = sorted({"".join(g.choice("-suaxSUAX") for _ in range(g.randrange(12))) for _ in range(400)} | {"su" + "au" * 50 + x for x in "suax-"})
    trie = trie_repair.Trie()
    for w in words:
        trie.go(w)
    assert trie.computed == len({w[:i] for w in words for i in range(1, len(w) + 1)})
    name = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    for w, cost, audit in trie_repair.answers(words):
        if len(w) < 8:
            items = [("user", "blank") if c == "-" else (name[c.lower()], "truncated" if c.isupper() else None) for c in w]
            assert (cost, audit) == cheapest(items)[:2], w
    long_ = "sua" + "ua" * 20000 + "X"
    assert next(trie_repair.answers([long_]))[1] == 4


# --------------------------------------------------------------------------- source audit


def test_source_audit_edges_equal_sql(spark):
    g = random.Random(6)
    vocab = [f"{a}{b}" for a in ("alpha", "Beta", "é", "çA", "_x1y") for b in ("", "Z", "-q", "ö")]
    rows = [(i, " ".join(g.choice(vocab) for _ in range(g.randrange(40))), g.choice(["en", "de", None]), g.choice(["s1", "s2", "S3", None, "ß"]), "x", 1) for i in range(150)]
    rows += [(900, "only three words", "xx", "lonely", "x", 1), (901, None, "yy", "a", "x", 1), (902, "", "yy", "b", "x", 1), (903, "hapax", "yy", None, "x", 1), (None, "long Text " * 30000, "en", "s9", "x", 1), (None, "long Text " * 30000, "en", "s9", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, term string, n int")
    con = duckdb.connect()
    pdf = df.toPandas()  # noqa: F841
    con.execute("CREATE VIEW documents AS SELECT * FROM pdf")
    got, want = [tuple(r) for r in source_audit.audit(df).collect()], con.execute(queries.oracle_sql()["op13_source_audit"]).fetchall()
    assert sorted(got) == sorted(want) and {r[0] for r in got} == {"", "en", "de", "yy"}
    assert source_audit.audit(df.limit(0)).count() == 0


@pytest.mark.parametrize("held", [64, 1 << 18])
def test_joint_counts_equal_pairs_of_terms(held, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(source_audit, "_HELD", held)
    g = random.Random(1)
    terms = [(g.choice("ab"), sorted((s, g.randrange(1, 4)) for s in g.sample(range(1, 9), g.randrange(1, 8)))) for _ in range(500)]
    want = {}
    for lang, at in terms:
        for i, (a, x) in enumerate(at):
            for b, y in at[i + 1 :]:
                want[lang, a, b, x, y] = want.get((lang, a, b, x, y), 0) + 1
    batch = pa.RecordBatch.from_arrays([pa.array([t[0] for t in terms]), pa.array([[s for s, _ in t[1]] for t in terms], pa.list_(pa.int64())), pa.array([[c for _, c in t[1]] for t in terms], pa.list_(pa.int64()))], names=["lang", "s", "c"])
    got = {}
    for out in source_audit._tally(iter([batch.slice(0, 200), batch.slice(200)])):
        for *key, m in zip(*(c.to_pylist() for c in out.columns), strict=True):
            got[tuple(key)] = got.get(tuple(key), 0) + m
    assert got == want
