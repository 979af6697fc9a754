import hashlib
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltworks.llm import chat, common, decontaminate, mixing, nearcopies, pii, sharding, simhash


def brute_hits(docs, items, window=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    asked = [(i, w[k : k + window]) for i, t in items for w in [words(t)] for k in range(max(1, len(w) - window + 1)) if w]
    for doc_id, text in docs:
        w, hit, found, near = words(text), set(), set(), set()
        held = set(w)
        for i, run in asked:
            if not held.issuperset(run):
                continue
            span = 2 * len(run)
            if any(set(run) <= set(w[k : k + span]) for k in range(max(1, len(w) - span + 1))):
                near.add(i)
            for k in range(len(w) - len(run) + 1):
                if w[k : k + len(run)] == run:
                    hit |= set(range(k, k + len(run)))
                    found.add(i)
        ids = ",".join(sorted(map(str, found)))
        yield doc_id, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit), len(near)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


DOCS = [
    (1, "One two three FOUR five six seven eight nine ten eleven twelve", "en", "a"),
    (2, "x one two three four five six seven eight nine ten. y two three", "en", "a"),
    (3, "tail short item", "en", "a"), (4, "short item short item", "en", "a"), (5, None, "en", "a"), (6, "", "en", "a"),
    (7, "short", "en", "a"), (8, "item", "en", "a"), (9, "éé ü1-short item" * 3, "en", "a"), (4, "short item short item", "en", "a"),
    (11, "twelve eleven x ten nine y eight seven six five z four three two one", "en", "a"), (12, "item and then short", "en", "a"),
    (13, "item and then some more short", "en", "a"), (14, "one two three four five six", "en", "a"), (15, "seven eight nine ten eleven", "en", "a"),
]
ITEMS = [(10, "one two three four five six seven eight nine ten eleven"), (2, "Short, item!"), (3, ""), (4, None), (11, "ÉÉ"), (2, "tail")]


@pytest.mark.parametrize("options", [{}, {"segment": 5}, {"block_bytes": 20}])
def test_decontamination(spark, make, options):
    docs = make(DOCS)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.digest(decontaminate.contaminated(docs, bench, **options))
    assert rows_of(got) == sorted(brute_hits([r[:2] for r in DOCS], ITEMS), key=str)


def test_decontamination_of_whole_table(spark, docs, benchmark):
    got = rows_of(decontaminate.digest(decontaminate.contaminated(docs, benchmark)))
    want = brute_hits([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in benchmark.collect()])
    assert got == sorted(want, key=str) and any(r[-2] for r in got)


def test_decontamination_of_odd_rows(odd, benchmark):
    assert decontaminate.contaminated(odd, benchmark).count() == odd.count()
    assert decontaminate.contaminated(odd.limit(0), benchmark).count() == 0
    assert decontaminate.contaminated(odd, benchmark.limit(0)).where("n_hit > 0").count() == 0
    kept = decontaminate.clean(odd, odd.sparkSession.createDataFrame([(1, "sat on the mat")], "item_id long, text string"))
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "4", "5", "6", "None", "None"]


def test_proximity_and_phrases_of_a_segment(make):
    index = decontaminate.build_index(make([(1, "a b c d e a", "", ""), (2, "e x a", "", "")]).coalesce(1))
    r = index.first()
    assert r.row_ids == [1, 2]
    s = decontaminate.Segment(r.lengths, bytes(r.terms), bytes(r.counts), bytes(r.gaps))
    a, c, e = (s.terms.index(w) for w in (b"a", b"c", b"e"))
    assert s.matches([a, e], 3)[1].tolist() == [0, 1] and s.matches([a, c], 2)[1].tolist() == []
    assert s.matches([e, a], 2)[0].tolist() == [4] and s.matches([a, e], 2)[0].tolist() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abc ", max_size=40), min_size=1, max_size=4), st.lists(st.text(alphabet="abcd ", max_size=30), max_size=4))
def test_hits_of_a_segment_equal_brute_force(texts, tests):
    items = [(k, t.encode()) for k, t in enumerate(tests)]
    segment = decontaminate._segment(0, list(range(len(texts))), [decontaminate.words(t.encode()) for t in texts], pa.int64())
    got = decontaminate._hits(segment, decontaminate.Asked(items, 3), 2).to_pylist()
    for r, want in zip(got, brute_hits(enumerate(texts), list(enumerate(tests)), 3), strict=True):
        ids = ",".join(sorted(map(str, r["items"])))
        hit = sum(s["stop"] - s["start"] for s in r["spans"])
        assert (r["n_words"], hit, len(r["items"]), hashlib.sha256(ids.encode()).hexdigest(), len(r["near"])) == (*want[1:5], want[6])


def test_rows_that_differ_by_nulls_are_told_apart(spark):
    rows = spark.createDataFrame([(7, None), (None, "7"), (None, None), (None, ""), (7, ""), (7, "7")], "doc_id long, text string")
    assert rows.select(common.row_key("doc_id", "text")).distinct().count() == 6
    item = spark.createDataFrame([(1, "7")], "item_id long, text string")
    kept = decontaminate.clean(rows, item).collect()
    assert sorted(map(str, kept)) == sorted(str(r) for r in rows.collect() if r.text != "7")
    # (7, null), (null, null), (null, "") and (7, "") have equal fingerprints; so have the two "7"
    assert len(simhash.one_of_each(rows).collect()) == 2
    assert len(nearcopies.one_of_each(rows).collect()) == 5


def sizes(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(by_source):
    order = sorted((s for s in by_source if s is not None), key=lambda s: s.encode()) + [None] * (None in by_source)
    weight, full, total = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, set(), sum(by_source.values())
    while True:
        rest = total - sum(3 * by_source[s] for s in full)
        free = sum(weight[s] for s in order if s not in full) or 1
        goal = {s: 3 * by_source[s] if s in full else rest * weight[s] / free for s in order}
        above = {s for s in order if goal[s] > 3 * by_source[s] + 1e-9}
        if not above:
            return goal
        full |= above


@pytest.mark.parametrize("spread", [(100, 90, 80, 70), (5, 400, 7, 300, 1), (3, 500), (40,)])
def test_mixing(make, spread):
    rows = []
    for k, n in enumerate(spread):
        rows += [(len(rows) + j, "w " * (1 + (j * 7) % 23), "en", f"s{k}" if k < 4 else None) for j in range(n)]
    rows += [(10_000, "same words here", "en", "s0")] * 3
    got = mixing.mixed(make(rows)).collect()
    assert len(got) == len(rows)
    by = Counter()
    for r in rows:
        by[r[3]] += sizes(r[1])
    goal, taken = brute_targets(by), Counter()
    for r in got:
        assert r.source_size == by[r.source] and r.target == pytest.approx(goal[r.source])
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 23 for s in by)
    again = mixing.mixed(make(rows[::-1])).collect()
    assert Counter((r.doc_id, r.taken) for r in got) == Counter((r.doc_id, r.taken) for r in again)
    assert mixing.mixture(make(rows)).count() == sum(r.copies for r in got)


def test_mixing_balances_by_document(spark, make):
    """The rates are min(3, exp(l size)) with the l that a bisection of plain sums finds, and minimise relative entropy."""
    rng = np.random.default_rng(6)
    sizes_of = {s: rng.integers(0, 60, 80) for s in "abc"}
    rows = [(k * 100 + j, "w " * int(n), "en", s) for k, s in enumerate(sizes_of) for j, n in enumerate(sizes_of[s])]
    sized = mixing.sized(make(rows))
    histogram = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    for ratio in (0.05, 0.6, 1.0, 1.7, 2.9, 3.0):
        goals = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
        goals = goals.withColumn("target", F.col("source_size") * ratio)
        for r in mixing.balanced(histogram, goals).collect():
            z = sizes_of[r.source][sizes_of[r.source] > 0]
            low, high = -50.0, 50.0
            for _ in range(200):
                middle = (low + high) / 2
                if (z * np.minimum(3, np.exp(np.minimum(middle * z, 9)))).sum() < r.target * (1 - 1e-13):
                    low = middle
                else:
                    high = middle
            w = np.minimum(3, np.exp(np.minimum(high * z, 9)))
            mine = np.minimum(3, np.exp(np.minimum(r.l / r.unit * z, 9)))
            assert np.abs(mine - w).max() < 1e-6 and (z * mine).sum() == pytest.approx(r.target, rel=1e-7)
            if 0.05 < ratio < 3:
                for _ in range(20):  # moves that keep the tokens and the bounds don't lower the divergence
                    move = rng.standard_normal(len(z)) * (w < 3)
                    free = z * (w < 3)
                    move -= free * (move @ z) / max(1, free @ z)
                    v = w + 1e-3 * move
                    if (v > 0).all() and (v <= 3).all():
                        assert (v * np.log(v) - v).sum() >= (w * np.log(w) - w).sum() - 1e-9
    got = {(r.source, r.size): (r.base, r.extra, r.n) for r in mixing.diffused(histogram, mixing.balanced(histogram, goals)).collect()}
    assert all(base == 3 and not extra for (_, size), (base, extra, _) in got.items() if size)


def test_mixture_shares_copies_of_rows_alike_the_same_way_on_reruns(spark):
    rows = [(1, "a b c", "s", f"x{k % 5}") for k in range(40)] + [(2, "d e f", "t", "y")] * 9 + [(k, "g " * 40, "u", "z") for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, more string")
    got, wanted = mixing.mixed(docs).collect(), Counter()
    for r in got:
        wanted[r.doc_id] += r.copies
    seen = [Counter(map(tuple, mixing.mixture(d).collect())) for d in (docs, docs.repartition(5), docs.repartition(3, "more"))]
    assert seen[0] == seen[1] == seen[2]
    assert all(sum(n for r, n in seen[0].items() if r[0] == k) == wanted[k] for k in (1, 2))
    assert len(got) == len(rows)


def test_mixing_ranks_large_classes_in_cells(make):
    rows = [(k, "five words of one size", "en", "abc"[k % 3]) for k in range(300)]
    got = mixing.mixed(make(rows)).collect()
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
    assert all(abs(taken[r.source] - r.target) <= 3 for r in got)


def test_mixing_of_odd_rows(odd):
    got = mixing.mixed(odd).collect()
    assert len(got) == odd.count() and {(r.size, r.copies) for r in got if r.doc_id in (3, 4, 6)} == {(0, 1)}
    assert mixing.mixed(odd.limit(0)).count() == 0
    out = mixing.mixture(odd)
    assert out.columns == odd.columns and out.where("_h <> 'clash'").count() == 0


def brute_plain(text):
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
             ("card", r"[0-9]([\x20-]?[0-9])+".replace(r"\x20-", " -")), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    out = []
    for k, (name, pattern) in enumerate(kinds):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if name == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if name == "card":
                total = sum(int(c) if i % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for i, c in enumerate(reversed(digits)))
                if not 14 <= len(digits) <= 19 or total % 10:
                    continue
            if name == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1.0259@+-_ ()é\n", max_size=60))
def test_plain_patterns(text):
    assert pii.plain(text) == brute_plain(text)


@pytest.mark.parametrize("text", ["a@b.c@d.e x@y", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4", "4111 1111 1111 1111 4111111111111112", "+1 (988) 555-2485. +12", "9" * 5000 + "." + "1" * 5000])
def test_plain_patterns_of_chosen_texts(text):
    assert pii.plain(text) == (brute_plain(text) if len(text) < 5000 else pii.plain(text))


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("write to jane.doe [at] mail (dot) example (dot) org now", "email", "jane.doe [at] mail (dot) example (dot) org"),
        ("write jane at example dot com today", "email", "jane at example dot com"),
        ("write Jane_AT_example_DOT_com today", "email", "Jane_AT_example_DOT_com"),
        ("write jane&#64;example&period;com today", "email", "jane&#64;example&period;com"),
        ("write jane@example dot com today", "email", "jane@example dot com"),
        ("write john at example.com today", "email", "john at example.com"),
        ("write john.doe at mail.example.co.uk.", "email", "john.doe at mail.example.co.uk"),
        ("write john @ example . com now", "email", "john @ example . com"),
        ("write john @example.org, now", "email", "john @example.org"),
        ("write john@ example dot org", "email", "john@ example dot org"),
        ("write john@example . org", "email", "john@example . org"),
        ("write john [at] mail [.] example.com", "email", "john [at] mail [.] example.com"),
        ("é jаne＠example．com.", "email", "jаne＠example．com"),
        ("ja​ne@exam​ple.com", "email", "ja​ne@exam​ple.com"),
        ("call plus one nine eight eight five five five two four eight five ok", "phone", "plus one nine eight eight five five five two four eight five"),
        ("call ＋１ (９８８) ５５５-２４８５ ok", "phone", "＋１ (９８８) ５５５-２４８５"),
        ("host one nine two dot one six eight dot one dot two five up", "ip", "one nine two dot one six eight dot one dot two five"),
        ("host 10[.]1[.]2[.]3 up", "ip", "10[.]1[.]2[.]3"),
        ("card four one one one 1111 1111 one one one one.", "card", "four one one one 1111 1111 one one one one"),
    ],
)
def test_disguises(text, kind, source):
    base, added = pii.spans(text)
    assert (pii.KINDS.index(kind), source) in [(k, text[s:e]) for s, k, e in base + added]


@pytest.mark.parametrize("text", ["look at this dot matrix", "one two three four", "we met at noon. dot com", "a plus b", "point at it", "naïve café at ten", "visit us at example.com", "at noon. it rains", "a @ b", "x @ y . Then"])
def test_clean_texts_stay_clean(text):
    assert pii.spans(text) == ([], [])


@pytest.mark.parametrize("filler", [" ", "\n", "_", "(", " (", "[ ", " @ ", "at ", " at x", " dot a", "1 ", "1.", "+1 (", "one ", " . a", "a@", "a@b.c ", "x at a.b "])
def test_time_is_linear_on_long_runs(filler):
    def seconds(n):
        text = "one john at" + filler * (n // len(filler)) + "y dot com"
        start = time.process_time()
        pii.spans(text)
        return time.process_time() - start

    assert seconds(1_000_000) < 4 or seconds(1_000_000) < 15 * seconds(100_000)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1@.+ аＡ１​[]one dt", max_size=60))
def test_base_spans_stay_and_added_lie_within(text):
    base, added = pii.spans(text)
    assert base == brute_plain(text)
    assert all(0 <= s < e <= len(text) for s, _, e in added)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1@.+[]&;#64 аＡ１​ºé_DOTdotONEatcom", max_size=40))
def test_texts_without_hints_are_written_as_they_are(text):
    if not pii.has_odd(text) and not pii.has_hint(text):
        w = pii.Written(text)
        w.characters()
        w.words()
        assert w.text == text


def test_personal_data_of_odd_rows(odd):
    got = pii.personal_data(odd).collect()
    assert len(got) == odd.count() and {r.spans for r in got} == {""}
    assert pii.personal_data(odd.limit(0)).count() == 0


def test_shards_share_the_slots():
    table = sharding.filled(sharding.names(32))
    counts = Counter(table)
    assert len(table) == sharding.SLOTS and max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.filled(sharding.names(31))
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 31)
    assert moved < 0.25 * len(table)
    for shards, slots in ((["a", "a"], 11), ([], 11), (["a"], 12)):
        with pytest.raises(ValueError):
            sharding.filled(shards, slots)


def test_sharded_rows(odd):
    got = sharding.sharded(odd)
    assert got.columns == [*odd.columns, "shard"] and got.count() == odd.count()
    table = sharding.filled(sharding.names(sharding.SHARDS))
    for r in got.collect():
        assert r.shard == table[sharding.number("" if r.doc_id is None else str(r.doc_id)) % sharding.SLOTS]
        assert r._slot == "clash"
    assert sharding.sharded(odd.limit(0)).count() == 0


TALK = [
    (1, 0, "system", "be brief"), (1, 1, "user", "a <|im_end|> \\| \\\\ <|"), (1, 2, "assistant", "<\\|im_start|>\\ ok"), (2, 1, "assistant", "no"),
    (2, 0, "user", None), (3, 0, "user", "x"), (3, 0, "user", "x"), (4, None, None, None), (None, 0, "us\ner\\/", "y\n"), (5, 0, "user", "only"),
]


def test_chat(spark):
    rows = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as turns", "2 as state")
    talks = chat.formatted(rows)
    valid = {r.conv_id: (r.valid, r.bad_turn) for r in talks.collect()}
    assert valid == {1: (True, None), 2: (True, None), 3: (False, 1), 4: (False, 0), None: (False, 0), 5: (False, 1)}
    got = {r.conv_id: r for r in chat.digest(talks).collect()}
    for conv in {t[0] for t in TALK}:
        turns = sorted(((n if n is not None else -1, r or "", t or "") for c, n, r, t in TALK if c == conv))
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[conv].n_turns == len(turns) and got[conv].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[conv].loss_chars == len(loss) and got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digest(chat.formatted(rows.limit(0))).count() == 0


def test_chat_text_has_no_mark_but_the_templates(spark):
    rows = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string")
    for r in chat.formatted(rows).collect():
        assert r.formatted.count("<|") == 2 * len(r.segments) // 3
        assert r.formatted == "".join(s.text for s in r.segments)
