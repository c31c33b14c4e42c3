import random

import pytest
from pyspark.sql import functions as F

from strandweave.llm import format_dupes, leakage, mixture, truncation

# ---------------------------------------------------------------- 1


NAMES = [
    ("e1", "warm Jisopiha shard"), ("e2", "“WARM/Jisopiha/shard”"), ("e3", "warmJisopihaShard,"), ("e4", "warm Jisopiha shard (level: 1)"), ("e5", "WARM_jisopiha_shard [Level=1]"),
    ("e6", "warm Jisopiha shard; tier : 2; level : 1"), ("e7", "warm Jisopiha shard​ {LEVEL=1 TIER=2}"), ("e1", "warm Jisopiha shard"), ("e8", None), (None, "warm Jisopiha shard"), ("e9", ""), ("f1", "--"), ("f2", "shard warm Jisopiha"),
]


def test_format_duplicates(spark):
    d = spark.createDataFrame([("t", i, n, 1) for i, n in NAMES], "tbl string, id string, text string, base int")
    got = {(r.keep_id, r.dup_id) for r in format_dupes.format_duplicates(d, ["tbl"]).collect()}
    assert got == {("e1", "e2"), ("e1", "e3"), ("e4", "e5"), ("e6", "e7"), ("e9", "f1")}
    rec = {r.keep_id: r for r in format_dupes.format_records(d, ["tbl"]).collect()}
    assert (rec["e1"].n_rows, rec["e1"].n_spellings, rec["e1"].n_ids) == (4, 3, 3) and rec["e6"].quals == "level:1;tier:2"
    assert format_dupes.format_duplicates(d.where("false"), ["tbl"]).count() == 0


def test_one_text_on_most_rows(spark):
    d = spark.range(3000).select(F.lit("t").alias("tbl"), F.format_string("i%05d", "id").alias("id"), F.when(F.col("id") % 3 > 0, F.lit("Hot Name")).otherwise(F.concat(F.lit("n "), "id")).alias("text"))
    got = format_dupes.format_duplicates(d, ["tbl"])
    assert got.count() == 1999 and {r[0] for r in got.select("keep_id").distinct().collect()} == {"i00001"}


# ---------------------------------------------------------------- 6


def _brute_infix(p, t):
    prev = list(range(len(p) + 1))
    best = prev[-1]
    for w in t:
        cur = [0]
        for i, x in enumerate(p, 1):
            cur.append(min(prev[i] + 1, cur[-1] + 1, prev[i - 1] + (x != w)))
        prev, best = cur, min(best, cur[-1])
    return best


def test_infix_distance():
    rnd = random.Random(1)
    for _ in range(500):
        p, t = [[rnd.choice("abcd") for _ in range(rnd.randrange(n))] for n in (9, 20)]
        assert leakage.infix_distance(p, t) == _brute_infix(p, t)


def test_pieces_fit_every_window():
    for edits in (0, 1, 2, 3):
        length, starts = leakage.pieces(60, 12, edits)
        for a in range(60 - 12 + 1):
            assert sum(a <= s and s + length <= a + 12 for s in starts) >= edits + 1


def test_leaks_against_brute_force(spark):
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    text = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(f"q{i}", text(rnd.choice([5, 11, 12, 20, 40])), text(30)) for i in range(12)]
    pages = []
    for i in range(120):
        w = text(rnd.randrange(60))
        if rnd.random() < 0.6:
            src = rnd.choice(items)[rnd.choice([1, 2])]
            n = rnd.choice([10, 11, 12, 13, 25])
            a = rnd.randrange(max(1, len(src) - n + 1))
            part = src[a : a + n]
            if rnd.random() < 0.4:
                part[rnd.randrange(len(part))] = "other"
            w[len(w) // 2 : len(w) // 2] = part
        sep = rnd.choice([" ", " - ", "\n", ", "])
        pages.append((i, sep.join(w).upper() if rnd.random() < 0.3 else sep.join(w)))
    pages += [(900, None), (901, ""), (None, "x")]
    docs = spark.createDataFrame(pages, "doc_id long, text string").withColumn("item_id", F.lit(1))
    evals = spark.createDataFrame([(i, " ".join(a), " ".join(b)) for i, a, b in items] + [(None, "a", "b"), ("n", None, None)], "item_id string, question string, gold string")
    got = {(r.doc_id, r.item_id, r.field): r.n_edits for r in leakage.leaks(docs, evals, ["question", "gold"]).collect()}
    want = {}
    for d, t in pages:
        w = leakage.words(t or "")
        for i, a, b in items:
            for f, x in (("question", a), ("gold", b)):
                e = min([_brute_infix(x[s : s + 12], w) for s in range(len(x) - 11)] or [9])
                if e <= 1 and d is not None:
                    want[d, i, f] = e
    assert got == want and 0 in want.values() and 1 in want.values()
    assert leakage.leaks(docs.where("false"), evals, ["question"]).count() == 0
    assert leakage.leaks(docs, evals.where("false"), ["question"]).count() == 0


def test_words_of_many_texts_at_once_are_those_of_each():
    """Also where a lower case has two characters or depends on what stands around it, beyond 16 bits, and where texts meet."""
    rnd = random.Random(5)
    odd = list("aB1_ .'-\n\t\x00\x1c") + list("ÀßİıΑΣσς١²ªǅ—’\u0345\u200b\u3000ꙮ𝔄𐐀😀")
    texts = ["", "ΑΣ.Α ΑΣ 'Σ", "İstanbul", "one two", "", "three 𐐀x"] + ["".join(rnd.choice(odd) for _ in range(rnd.randrange(12))) for _ in range(5000)]
    texts += ["a" + chr(c) + "B" for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    low, start, end, n = leakage.word_places(texts)
    w = iter([low[a:b].tobytes().decode("utf-32-le") for a, b in zip(start.tolist(), end.tolist())])
    assert [[next(w) for _ in range(k)] for k in n.tolist()] == [leakage.words(t) for t in texts]


def test_runs_of_words_end_where_a_text_ends():
    texts = ["one two", "three four five six seven", "", "x; THREE four, Five six"]
    h, first, text = leakage.run_hashes(*leakage.word_places(texts), 4)
    assert first.tolist() == [2, 3, 7, 8] and text.tolist() == [1, 1, 3, 3] and h[0] == h[3] and len(set(h.tolist())) == 3
    parts = list(leakage._in_parts(["a", "b", "c"], ["x" * leakage.PART, "y" * (3 * leakage.PART), "z"]))
    assert [i for p, _ in parts for i in p] == ["a", "b", "c"] and all(ids for ids, _ in parts)
    assert list(leakage._in_parts([], [])) == []


# ---------------------------------------------------------------- 7


def test_mixture_meets_shares_and_caps(spark):
    words = "the quick brown fox jumps over a lazy dog near some river bank".split()
    rnd = random.Random(7)
    n = {"a": 400, "b": 60, "c": 30, "d": 50}
    docs = [(i, s, " ".join(rnd.choice(words) for _ in range(rnd.randrange(5, 40)))) for i, s in enumerate(s for s, k in n.items() for _ in range(k))]
    docs += [(9001, "a", None), (9002, "a", ""), (9003, None, "x y"), (9004, "b", "same"), (9004, "b", "same")]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumns({"tokens": F.lit(1), "position": F.lit("x")})
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.1, 4), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")
    m = mixture.mix(d, t, mixture.largest_exact, bucket_rows=50).collect()
    total = sum(r.tokens for r in m)
    share = {s: sum(r.tokens for r in m if r.source == s) / total for s in "abc"}
    for s, want in (("a", 5 / 9), ("b", 3 / 9), ("c", 1 / 9)):
        assert share[s] == pytest.approx(want, abs=0.01)
    assert [r.position for r in m] == sorted(r.position for r in m) and 0 <= m[0].position and m[-1].position <= 1
    assert max(r.repeat_no for r in m if r.source == "a") == 1 and max(r.repeat_no for r in m) <= 4
    half = [r for r in m if r.position < 0.5]
    lo = {s: sum(r.tokens for r in half if r.source == s) / sum(r.tokens for r in half) for s in "ab"}
    assert lo["a"] > share["a"] and lo["b"] < share["b"]  # what is repeated comes later
    rep = {r.source: r for r in mixture.shares_report(mixture.mix(d, t, mixture.all_tokens), t).collect()}
    assert rep["none"].actual_share == 0 and rep["none"].shortfall == 0.1 and rep["c"].most_uses <= 4 and rep["a"].most_uses == 1
    assert all(r.shortfall == pytest.approx(max(0, r.target_share - r.actual_share), abs=1e-5) for r in rep.values())
    assert sum(r.tokens for r in mixture.mix(d, t, 500).collect()) == pytest.approx(500, abs=60)
    assert mixture.mix(d.where("false"), t, mixture.all_tokens).count() == 0 and mixture.mix(d, t.where("false"), mixture.all_tokens).count() == 0


def test_times_invert_the_schedule():
    shares, reps = {"a": 0.7, "b": 0.3}, {"a": 1, "b": 5}
    k = mixture.tilted_schedule(shares, reps)
    for t in (0, 1):
        assert sum(v[t][1] for v in k.values()) == pytest.approx(1)
    assert all((v[0][1] + v[1][1]) / 2 == pytest.approx(shares[s]) for s, v in k.items())


def test_token_counts_are_those_of_the_tokenizer(spark):
    text = ["hello world", "naïve — ünïcode 🙂 \x00 text", "x" * 5000]
    d = spark.createDataFrame([(i, "s", t) for i, t in enumerate(text)], "doc_id long, source string, text string")
    got = {r.doc_id: r.tokens for r in mixture.token_counts(d).collect()}
    enc = mixture._encoder(mixture.tokenizer_file())
    for i, t in enumerate(text):
        ids = enc.encode_ordinary(t)
        assert got[i] == len(ids) and enc.decode(ids) == t


# ---------------------------------------------------------------- 8


@pytest.mark.parametrize(
    "text, cut",
    [
        ("A full sentence.", False), ("Is it?  ", False), ("", False), ("He said “so.”", False), ("# Head\n\n- one\n- two.", False), ("text\n\n| a | b |\n| 1 | 2 |", False), ("```\ncode\n```", False), ("See [x](y.md)", True),
        ("The cut comes in the mid", True), ("Text. And then [...]", True), ("Text that sto…", True), ("text\n\n```sql\nselect 1", True), ("a (b c", True), ("| a | b |\n| 1 |", True), ("| a | b |\n| 1 | 2", True), ("x�", True), ("CALL a\\", True),
        ("See also: [Name](../a", True), ("an <a href='x", True), ("ends, said “I", True),
        ('He said "this is fine.', True), ("He said 'abc.", True), ("A **bold claim.", True), ("Use `code.", True), ("<div>Text is here.", True), ("Open (a\n\nNext.", True), ("Fine &am", True), ("see %E2%8", True), ("see %E2%82", True), ("x \\u12", True),
        ('"All" is **well** `here(`.', False), ("The 'quoted' word's users' list.", False), ('A 5" disk.', False), ("It is 100%.", False), ("<p>One<br>two.", False), ("<b>Bold</b> and <path> here.", False), ("R&D.", False), ("see %E2%82%AC.", False), ("a) first\n\nb) last.", False),
    ],
)
def test_judge(text, cut):
    assert (truncation.judge(text)[0] is not None) == cut


def test_truncation_over_a_corpus(spark):
    rnd = random.Random(3)
    names = ["Alpha", "Beta", "Gamma", "Delta"]
    rows = []

    def page(i, src, text):
        rows.append((i, src, text))

    for i in range(300):
        body = " ".join(f"The {rnd.choice(names)} index keeps {rnd.randrange(99)} rows." for _ in range(6))
        page(i, f"s{i % 3}", body + f"\n\n- {rnd.choice(names)} index\n- The {rnd.choice(names)}\n\n" + rnd.choice(["## To do", "Page 3 of 9", "(c) team", "- Gamma index"]))
    for i in range(300, 360):
        page(i, "limited", ("The Alpha index keeps 12 rows. " * 20)[:200])
    page(400, "s0", "Text here.\n\n- Alpha ind")
    page(401, "s0", "Text here.\n\n- The")
    page(402, None, "No terminator at the end")
    page(403, "s1", None)
    page(404, "s1", "")
    page(405, "s1", "word " * 20000)
    page(402, None, "No terminator at the end")
    for i in range(500, 530):
        page(i, "bare", f"a title without a stop {i}x{'y' * (i % 17)}")
    d = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("reason", F.lit(1))
    got = {r.doc_id: r for r in truncation.judged(d).collect()}
    assert {k for k, r in got.items() if r.cut} == {*range(300, 360), 400, 401, 402, 405}
    assert 403 not in got and not got[404].cut and len(got) == len({r[0] for r in rows}) - 1
    s = {r.source: r for r in truncation.truncation_shares(truncation.judged(d)).collect()}
    assert s["limited"].share == 1.0 and s["bare"].n_cut == 0 and s[None].n_cut == 1
    assert truncation.judged(d.where("false")).count() == 0


def test_cuts_do_not_make_a_habit_and_rare_words_may_end_texts(spark):
    rnd = random.Random(5)
    names = ["Alpha", "Beta", "Gamma", "Delta"]
    say = lambda: f"The {rnd.choice(names)} index keeps {rnd.randrange(10**6)} rows."
    rows, cut = [], set()
    for i in range(120):  # 90 of 120 pages stop inside a sentence, in one source after whole paragraphs, in the other inside their only one
        whole = [f"{say()} {say()}" for _ in range(3)] if i % 2 else [" ".join(say() for _ in range(4))]
        stop = "" if i % 8 < 2 else f" {say()[: rnd.randrange(5, 12)]} q{chr(97 + i % 26) * (1 + i // 26)}"
        rows.append((i, f"torn{i % 2}", "\n\n".join(whole) + stop))
        cut |= {i} if stop else set()
    for i in range(200, 240):  # paragraphs without terminators are the habit here
        rows.append((i, "bare", f"a note {i} on {'x' * (i % 19)}\n\nanother {i} of {'y' * (i % 17)}\n\nthe last {i} v{'w' * (i % 13)}"))
    rows += [(300 + i, "s", f"The Zorb index keeps {i} rows.\n- {names[i % 4]} index\nText {'t' * i} ends.") for i in range(30)]
    rows.append((400, "s", "Text here.\n\n- Zorb"))
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert {r.doc_id for r in truncation.judged(d).where("cut").collect()} == cut
