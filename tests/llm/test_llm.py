import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("prismlake.llm")
import prismlake.llm.leaks as leaks_module  # noqa: E402
from prismlake.llm import languages, mixture, sentences  # noqa: E402
from prismlake.llm.clusters import clusters, describe, leaves, ward  # noqa: E402
from prismlake.llm.copies import copies  # noqa: E402
from prismlake.llm.leaks import Windows, clean, leaks, spans, without, words  # noqa: E402
from prismlake.llm.neighbours import nearest  # noqa: E402
from prismlake.llm.survivors import groups, survivors, truths  # noqa: E402
from prismlake.llm.trie import near_codes, self_join  # noqa: E402

VEC = "id bigint, vec array<float>"


def planted(rng, n_groups, size, dim, spread):
    centre = rng.standard_normal((n_groups, dim))
    x = np.repeat(centre / np.linalg.norm(centre, axis=1)[:, None], size, axis=0)
    x = x + spread * rng.standard_normal(x.shape) / np.sqrt(dim)
    return x.astype(np.float32)


# --- 1


def brute_codes(code, budget):
    return {(i, j) for i in range(len(code)) for j in range(i + 1, len(code)) if bin(int(code[i]) ^ int(code[j])).count("1") <= budget}


def test_trie_join_equals_brute_force():
    rng = np.random.default_rng(0)
    code = np.unique(np.concatenate([rng.integers(0, 1 << 63, 150, dtype=np.uint64), rng.integers(0, 1 << 12, 150, dtype=np.uint64)]))
    flips = code[:100] ^ (np.uint64(1) << rng.integers(0, 64, 100, dtype=np.uint64))
    code = np.unique(np.concatenate([code, flips]))
    for budget in (0, 3, 6):
        got = {(int(i), int(j)) for a, b in self_join(code, [(0, len(code))], budget) for i, j in zip(a, b, strict=True)}
        assert got == brute_codes(code, budget)


def test_near_codes_on_spark(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-(1 << 62), 1 << 62, 60)
    code = np.unique(np.concatenate([base, base ^ 1, base ^ 0b1011, [0, -1, 1]]))
    df = spark.createDataFrame([(int(c), "x") for c in code], "code bigint, extra string")
    for n in (len(code), 1 << 40):  # few and many bands
        got = {(r[0], r[1]) for r in near_codes(df, 3, n, tasks=8).collect()}
        u = code.view(np.uint64)
        assert got == {tuple(sorted((int(code[i]), int(code[j])))) for i, j in brute_codes(u, 3)}
    assert near_codes(df.limit(0), 3, 0).count() == 0


def copies_by_hand(rows):
    out = set()
    for i, (ia, ha, va) in enumerate(rows):
        for ib, hb, vb in rows[i + 1 :]:
            bits = None if ha is None or hb is None else bin((ha ^ hb) & (2**64 - 1)).count("1")
            good = va is not None and vb is not None and len(va) == len(vb) == 8 and np.linalg.norm(va) > 1e-12 and np.linalg.norm(vb) > 1e-12
            cos = float(np.dot(va, vb) / np.linalg.norm(va) / np.linalg.norm(vb)) if good else None
            ones = lambda h: bin(h & (2**64 - 1)).count("1")
            if good and bits is not None:
                hit = bits <= 6 and cos >= 0.95
            elif good:
                hit = cos >= 0.98
            else:
                hit = bits is not None and bits <= 3 and 5 <= ones(ha) <= 59 and 5 <= ones(hb) <= 59
            if hit:
                out.add((min(ia, ib), max(ia, ib)))
    return out


def test_copies_equal_brute_force_with_nulls_and_hot_values(spark):
    rng = np.random.default_rng(2)
    x = planted(rng, 12, 10, 8, 0.35).tolist()
    h0 = [int(v) for v in rng.integers(-(1 << 62), 1 << 62, 12)]
    rows = []
    for i, v in enumerate(x):
        h = h0[i // 10] ^ (1 << int(rng.integers(0, 60)))
        rows.append((i, [h, None, 0, h][i % 4], [v, v, v, None][i % 4] if i % 7 else [0.0] * 8))
    rows += [(500, None, None), (501, 3, [1.0]), (502, h0[0], x[0]), (503, h0[0], x[0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id bigint, hash bigint, vec array<float>, media_a int")
    got = {tuple(r) for r in copies(df, 8).collect()}
    assert got == copies_by_hand(rows)
    assert copies(df.limit(0), 8).count() == 0
    same = [(i, 12345678901, [1.0, 2.0] + [0.0] * 6) for i in range(300)]  # one hot hash
    assert copies(spark.createDataFrame(same, "id bigint, hash bigint, vec array<float>"), 8).count() == 300 * 299 // 2


def test_copies_of_a_hot_hash_miss_no_pair_across_cells(spark, monkeypatch):
    from prismlake.llm import copies as module

    monkeypatch.setattr(module, "CELL_ROWS", 50)
    monkeypatch.setattr(module, "TILE_ROWS", 64)
    turn = np.linspace(0, 2 * np.pi, 400, endpoint=False)
    x = np.zeros((400, 96), np.float32)  # on a circle a partner lies in the very direction of the next cell
    x[:, 0], x[:, 1] = np.cos(turn), np.sin(turn)
    code = np.where(np.arange(400) % 20, 12345678901, 12345678900)
    df = spark.createDataFrame([(i, int(h), v.tolist()) for i, (h, v) in enumerate(zip(code, x, strict=True))], "id bigint, hash bigint, vec array<float>")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = {(int(a), int(b)) for a, b in np.argwhere(np.triu(u @ u.T >= 0.95, 1))}
    got = [tuple(r) for r in copies(df, 96).collect()]
    assert len(got) == len(want) and set(got) == want


# --- 2


def test_groups_and_survivors(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (7, 9)], "media_a bigint, media_b bigint")
    members = groups(pairs)
    assert {tuple(r) for r in members.select("media_id", "group_id").collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (9, 7)}
    nan = float("nan")
    analysis = spark.createDataFrame([(1, 5.0, 0.5, 1), (2, 4.0, 2.0, 3), (3, nan, 0.1, 3), (7, 1.0, 1.0, 0), (9, None, None, 2)], "mediaId bigint, sharpness float, brightness float, qualityVersion int")
    media = spark.sql("select id, cast(t as timestamp_ntz) dateTaken, cast('2020-06-01' as timestamp_ntz) dateModified, size, width, height from values (1L, '2019-01-01', 5L, 10, 10), (2L, '2018-01-01', 5L, 10, 10), (3L, '1990-01-01', null, null, 1), (7L, '2021-01-01', 1L, 1, 1), (9L, null, 1L, 1, 1) as v(id, t, size, width, height)")
    got = {tuple(r) for r in survivors(members, analysis, media).select("group_id", "field", "media_id").collect()}
    assert got == {(1, "sharpness", 2), (1, "brightness", 3), (1, "dateTaken", 2)}


def test_truth_model_trusts_the_better_source(spark):
    rng = np.random.default_rng(3)
    rows = []
    for subject in range(200):
        for source, right in (("good", 0.95), ("fair", 0.8), ("bad", 0.2)):
            rows.append((subject, "f", "true" if rng.random() < right else f"wrong{rng.integers(3)}", source))
    rows += [(1000, "g", "a", "good"), (1000, "g", "b", "good"), (1001, None, "x", "good")]
    found = truths(spark.createDataFrame([(*r, 0) for r in rows], "subject bigint, field string, value string, source string, belief int")).collect()
    kept = {(r["subject"], r["value"]) for r in found if r["kept"] and r["field"] == "f"}
    assert sum((s, "true") in kept for s in range(200)) > 180
    assert {r["value"] for r in found if r["field"] == "g"} == {"a", "b"}
    assert truths(spark.createDataFrame([], "subject bigint, field string, value string, source string")).count() == 0


def test_truth_model_equals_expectation_maximisation_by_hand(spark):
    rng = np.random.default_rng(6)
    rows = []
    for subject in range(60):
        for source, says, lies in (("a", 0.9, 0.05), ("b", 0.7, 0.3), ("c", 0.5, 0.5)):
            rows += [(subject, "f", f"v{k}", source) for k in range(3) if rng.random() < (says if k < 2 else lies)]
    votes = {}
    for s, _, v, src in rows:
        votes.setdefault((s, v), set()).add(src)
    speak = {s: {src for t, _, _, src in rows if t == s} for s in range(60)}
    belief = {k: len(by) / len(speak[k[0]]) for k, by in votes.items()}
    for _ in range(8):
        sens, spec = {}, {}
        for src in "abc":
            mine = [k for k in votes if src in speak[k[0]]]
            said = lambda k, yes: (src in votes[k]) == yes  # noqa: B023, E731
            mass = lambda yes, true: sum(belief[k] if true else 1 - belief[k] for k in mine if said(k, yes))  # noqa: B023, E731
            sens[src] = (mass(True, True) + 5) / (mass(True, True) + mass(False, True) + 10)
            spec[src] = (mass(False, False) + 9) / (mass(True, False) + mass(False, False) + 10)
        belief = {k: 1 / (1 + np.exp(-sum(np.log(sens[x] / (1 - spec[x])) if x in by else np.log((1 - sens[x]) / spec[x]) for x in speak[k[0]]))) for k, by in votes.items()}
    got = {(r["subject"], r["value"]): r["belief"] for r in truths(spark.createDataFrame(rows, "subject bigint, field string, value string, source string")).collect()}
    assert got == pytest.approx(belief, abs=1e-9)
    # A field may have several true values: both that the good source asserts are kept, what it denies isn't.
    kept = lambda test: np.mean([belief[k] >= 0.5 for k in votes if test(k)])
    assert kept(lambda k: k[1] != "v2" and "a" in votes[k]) > 0.7 and kept(lambda k: k[1] == "v2" and "a" not in votes[k]) < 0.2


# --- 4


def test_leaves_and_ward_find_planted_groups():
    x = planted(np.random.default_rng(4), 6, 30, 64, 0.6)
    x /= np.linalg.norm(x, axis=1)[:, None]
    label, count, sums = leaves(x, 0.57, step=50)
    assert count.sum() == len(x)
    group = ward(count, sums, 0.57)[label]
    assert len(set(group)) == 6 and all(len(set(group[i * 30 : i * 30 + 30])) == 1 for i in range(6))


def test_clusters_on_spark(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([planted(rng, 4, 12, 32, 0.5), planted(rng, 1, 4, 32, 0.5), rng.standard_normal((20, 32)).astype(np.float32)])
    df = spark.createDataFrame([(100 + i, v.tolist()) for i, v in enumerate(x)], VEC)
    got = {r["member_id"]: r["cluster_id"] for r in clusters(df.union(df.limit(3)), len(x), 32).collect()}
    assert got == {100 + i: 100 + i // 12 * 12 for i in range(48)}
    found = describe(clusters(df, len(x), 32)).collect()
    assert sorted(r["size"] for r in found) == [12] * 4 and all(len(r["typical"]) == 3 for r in found)
    assert clusters(df.limit(0), 0, 32).count() == 0


# --- 6


def neighbours_by_hand(ids, x, k, least):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    out = set()
    for i in range(len(x)):
        c = np.round(u @ u[i], 12)
        order = sorted((-(c[j]), ids[j]) for j in range(len(x)) if j != i and c[j] >= least)
        out |= {(ids[i], j) for _, j in order[:k]}
    return out


def test_nearest_equals_brute_force_with_ties_and_repeats(spark):
    rng = np.random.default_rng(6)
    x = planted(rng, 20, 15, 24, 0.5)
    x[40:52] = x[40]  # equal vectors
    ids = list(range(1000, 1000 + len(x)))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in zip(ids, x, strict=True)], VEC + ", home int")
    got = {(r[0], r[1]) for r in nearest(df.union(df.limit(5)), len(x), 24, 5, 0.8).select("item_id", "neighbour_id").collect()}
    assert got == neighbours_by_hand(ids, x, 5, 0.8)
    assert nearest(df.limit(0), 0, 24, 5, 0.8).count() == 0


def test_nearest_recall_over_several_cells(spark, monkeypatch):
    from prismlake.llm import neighbours

    monkeypatch.setattr(neighbours, "LIST_ROWS", 100)
    x = planted(np.random.default_rng(7), 60, 20, 32, 0.4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VEC)
    got = {(r[0], r[1]) for r in nearest(df, len(x), 32, 5, 0.85).select("item_id", "neighbour_id").collect()}
    want = neighbours_by_hand(list(range(len(x))), x, 5, 0.85)
    assert len(got & want) >= 0.97 * len(want)


# --- 5


SAMPLES = {
    "en": "please return the {} before the end of the week|we are open every day except for the {}|how much did you pay for the {}",
    "de": "bitte die {} nicht neben der tür abstellen|wir haben heute wegen der {} leider geschlossen|ohne gültige {} ist der zutritt nicht gestattet",
    "fr": "merci de ne pas laisser la {} devant la porte|il faut garder la {} jusqu'à la fin du voyage|avec chaque {} un café vous est offert",
    "ru": "сегодня магазин закрыт потому что {} сломалась|просим не оставлять вещи у двери где {}|где сейчас {} которая была здесь вчера",
    "zh": "请不要把{}放在门口|今天因为{}的问题暂停营业|昨天放在这里的{}现在在哪里",
}


def test_language_model_survives_wrong_labels_and_splits_lines():
    rng = np.random.default_rng(8)
    texts, labels = [], []
    for _ in range(150):
        for lang, forms in SAMPLES.items():
            word = "".join(rng.choice(list("abdeiklmorst"), 5)) if lang != "zh" else "梯子"
            texts.append(rng.choice(forms.split("|")).format(word))
            labels.append(lang if rng.random() > 0.2 else rng.choice(list(SAMPLES)))
    model = languages.fit(texts, [str(x) for x in labels])
    right = sum(languages.cut_up(forms.split("|")[k].format("lampe"), model)[0][2] == lang for lang, forms in SAMPLES.items() for k in range(3))
    assert right == 15
    mixed = languages.cut_up("Please return the key before the end of the week | 今天因为梯子的问题暂停营业", model)
    assert [m[2] for m in mixed] == ["en", "zh"] and all(0 < m[3] <= 1 for m in mixed)
    for none in ("", "  ", "12:30", "* * * *", "7CA9BFD6-9222", "+3709385512"):
        assert languages.cut_up(none, model) == []
    assert languages.cut_up("we are open " * 20000, model)[0][2] == "en"


def test_document_frequencies_come_from_all_lines(spark):
    texts = ["we are open today", "wir haben heute offen", "zugzwang heute"] * 40 + [None, "", "12:30"]
    rows = [(i, t, ("en", "de", None)[i % 3]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id bigint, text string, label string").repartition(3)
    seen, n = languages.occurrences(texts)
    assert n == len(texts) - 1 and seen[languages.grams("heute")].min() >= 80
    assert np.array_equal(languages.train(df, 10).idf, np.log((1 + n) / (1 + seen)) + 1)
    assert languages.frequencies(df.limit(0))[1] == 0


def test_declared_languages_in_any_notation(spark):
    df = spark.createDataFrame([("EN",), ("en-US",), (" deu ",), ("zho",), ("und",), ("??",), (None,), ("",), ("pt_BR",)], "lang string")
    assert [r[0] for r in df.select(languages.known("lang")).collect()] == ["en", "en", "de", "zh", None, None, None, None, "pt"]


def test_passages_of_odd_lines(spark):
    model = languages.fit(["we are open today", "wir haben heute offen"] * 30, ["en", "de"] * 30)
    lines = spark.createDataFrame([(1, 1, None, None), (2, 1, "", "en"), (3, None, "we are open today", None)], "id bigint, mediaId bigint, text string, label string")
    found = {r["id"]: r["lang"] for r in languages.passages(lines, model).collect()}
    assert found == {1: None, 2: None, 3: "en"}
    assert languages.documents(languages.passages(lines.limit(0), model).withColumnRenamed("mediaId", "media_id")).count() == 0


# --- 7


ITEM = "a lamp maker from Kroujond lent 353 brass compasses to a stranger met at Josaven fair"


def test_leaks_need_twelve_words_and_join_hyphens(spark, monkeypatch):
    assert words("Foo-\nbar, BAZ_1") == ["foobar", "baz", "1"] and len(words("İstanbul")) == 1
    docs = [(1, f"x. {ITEM.upper()}!"), (2, "so a lamp ma-\n  ker from Kroujond lent 353 brass comp-\nasses to a stranger met. End"), (3, " ".join(ITEM.split()[:11])), (4, None), (5, ""), (6, f"{ITEM} {ITEM}")]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(9, ITEM), (9, ITEM), (10, "short one"), (11, None)], "item_id bigint, text string")
    want = {(1, 9), (2, 9), (6, 9)}
    assert {tuple(r) for r in leaks(df.drop("item_id"), items).collect()} == want
    cleaned = {tuple(r) for r in clean(df.drop("item_id"), items).collect()}
    # However many the items are, the result is the same.
    monkeypatch.setattr(leaks_module, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(leaks_module, "MAP_BITS", 1 << 21)
    assert {tuple(r) for r in leaks(df.drop("item_id"), items).collect()} == want
    assert {tuple(r) for r in clean(df.drop("item_id"), items).collect()} == cleaned
    kept = {r[0]: r[4] for r in cleaned}
    assert kept[1] == "x. !" and leaks(df.limit(0).drop("item_id"), items).count() == 0
    w = Windows([(9, ITEM)], 12)
    assert spans(docs[0][1], w) == [(9, 3, 3 + len(ITEM))] and without("nothing here", []) == "nothing here" and without("abcdef", [(1, 3), (2, 4)]) == "aef"


# --- 8


def test_water_filling_clamps_and_redistributes(spark):
    def fill(weight, most, total):
        counts = spark.createDataFrame([(s, m) for s, m in most.items()], "source string, tokens bigint")
        targets = spark.createDataFrame([(s, w, 1) for s, w in weight.items()], "source string, weight double, max_repeat int")
        return {r["source"]: r["planned"] for r in mixture.plan(counts, targets, total).collect()}

    got = fill({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 10, "b": 1000, "c": 1000}, 100)
    assert got["a"] == 10 and got["b"] == pytest.approx(54) and got["c"] == pytest.approx(36)
    assert fill({"a": 1.0, "b": 0.0}, {"a": 5, "b": 9}, 100) == {"a": 5, "b": 0}
    assert fill({}, {}, 10) == {} and fill({"a": 2.0, "b": 1.0}, {"a": 4, "b": 0}, 9) == {"a": 4, "b": 0}
    rng = np.random.default_rng(2)
    for _ in range(3):
        names = [f"s{i:02}" for i in range(12)]
        weight, most = {s: float(rng.random()) for s in names}, {s: int(rng.integers(1, 60)) for s in names}
        total = float(rng.integers(20, 400))
        level, left, free = {}, total, set(names)
        while free:  # clamp whoever goes over, share out again
            over = {s for s in free if weight[s] / sum(weight[t] for t in free) * left >= most[s]}
            if not over:
                level |= {s: weight[s] / sum(weight[t] for t in free) * left for s in free}
                break
            level |= {s: most[s] for s in over}
            left, free = left - sum(most[s] for s in over), free - over
        assert fill(weight, most, total) == pytest.approx(level)


def test_mix_reaches_its_plan(spark):
    rng = np.random.default_rng(9)
    rows = [(i, "big" if i % 10 else "small", int(rng.integers(1, 50))) for i in range(4000)] + [(9001, "big", 0)]
    counts = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 2), ("gone", 0.2, 3), (None, 1.0, 1)], "source string, weight double, max_repeat int")
    planned = mixture.plan(counts, targets)
    mixed = mixture.mix(counts, planned)
    by = {r["source"]: r for r in mixture.shares(mixed, planned).collect()}
    plan = {r["source"]: r["planned"] for r in planned.collect()}
    for s in ("big", "small"):
        assert abs(by[s]["used"] - plan[s]) <= 50
    assert by["small"]["most"] <= 2 and by["gone"]["used"] == 0
    assert mixed.groupBy("doc_id").count().where("count > 1").count() == 0
    assert mixture.mix(counts.limit(0), mixture.plan(counts.limit(0), targets)).count() == 0


# --- 9


def cut(text):
    at = sentences.starts(text)
    return [text[a:b].strip() for a, b in zip(at, [*at[1:], len(text)], strict=True)]


@pytest.mark.parametrize(
    "text, parts",
    [
        ("The panel sat until 6 p.m. We agree. Costs of Cr. 3.50 follow.", 3),
        ("Mr. Low and Dr. Hay gave evidence for Bel Ltd. Did it matter? It did not!", 3),
        ("He noted: “It is late. No leave was sought.” and closed the file. Next.", 2),
        ("The clause reads: “Pay now. Time is short.” Under s. 4 it binds.", 2),
        ("Im 3. Senat wird vertreten, dass z. B. nichts gilt. Am 2. Mai kam es anders. Nach § 3 Anm. 75. War es so?", 4),
        ("Elle répond (cf. Bull. mar. 2015, p. 146). Non ! Le taux de 3,5 % est nul.", 3),
        ("Quedan incluidos rentas, etc. El Sr. Bel paga. ¿Fue tardía? ¡En absoluto!", 4),
        ("Заявка поступила 9 марта 2004 г. Эксперты А. Б. Толбен и В. Г. Гордек были там. Нет!", 3),
        ("否である！書記官は「期限後である。延長もない。」と記録した。利率は7.1％である。", 3),
        ("यह अपील 4/5/1999 को हुई। डॉ. द्रवेल ने कहा। नहीं!", 3),
        ("كلا! شهد د. كوستن بذلك؛ ولم يعترض أحد. المبلغ هو 3.50.", 3),
        ("ศาลเห็นว่าพ้นกำหนดเวลาแล้ว ให้ยกคำร้อง จำนวนเงินที่พิพาทคือ 796,351.99 บาท คำร้องยื่นเมื่อวันที่ 22/7/2007", 4),
        ("It ended.Then it began. e-Filing was done.", 3),
    ],
)
def test_sentences_of_plain_texts(text, parts):
    assert len(cut(text)) == parts, cut(text)


@pytest.mark.parametrize(
    "text, parts",
    [
        ("เมื่อวานนี้ฉันไปตลาดกับแม่ เราซื้อผักและผลไม้หลายอย่าง ตอนเย็นพ่อทำอาหารให้ทุกคนกิน", 3),
        ("แมวนอนอยู่บนโซฟา หมาวิ่งเล่นในสวน เด็ก ๆ หัวเราะ", 3),
        ("ถ้าฝนตก ฉันจะอยู่บ้าน พรุ่งนี้เราจะไปทะเล", 2),
        ("รัฐบาลใช้เงิน 300 ล้านบาท เพื่อสร้างถนนใหม่ ชาวบ้านรู้สึกดีใจมาก นอกจากนี้โรงเรียนยังเปิดสอนภาษาอังกฤษ", 3),
        ("เขาซื้อส้ม กล้วย และ มะม่วง แล้วกลับบ้าน", 1),
        ("ตำรวจจับนายสมชาย รักไทยเจริญ ที่สนามบิน เขาปฏิเสธ", 2),
    ],
)
def test_sentences_of_everyday_thai(text, parts):
    assert len(cut(text)) == parts, cut(text)


def test_paragraphs_go_by_their_own_language():
    english = "The vote of May 3. It was the end of that, and the owner of the house paid to see it."
    german = "Am 3. Mai ist der Zeuge nicht in die Halle gekommen und das Gericht wird nach der Akte entscheiden. Das ist die Regel."
    text = "\n\n".join([english.strip()] * 30 + [german] * 30)
    assert len(cut(text)) == 119  # the first line stands where a caption does
    assert len(cut("\n\n".join([german] * 30 + [english.strip()] * 30))) == 119


@pytest.mark.parametrize(
    "text, parts",
    [
        ("She wrote “It is late. We left. The shop was shut.", 3),  # a quotation that is never closed is none
        ("He paid (see the list. Nobody minded. It was done.", 3),  # nor is a bracket
        ("He paid (see the list. Nobody minded). It was done.", 2),
        ("“Go. Now.” “Why? Where?” he asked. She left.", 3),
        ("Das Buch heißt „Ende. Anfang.“ und liegt dort. Es regnet.", 2),
        ("我昨天到家了 今天下雨", 2),
        ("我买了苹果 香蕉 和 梨", 1),
        ("昨日は雨が降りました しかし今日は晴れです", 2),
        ("りんご バナナ と みかんを買った", 1),
        ("Les chats dorment. Il pleut ! Où vas-tu ? Nulle part.", 4),
        ("Кошка спит. Идёт дождь! Куда ты идёшь? Т. е. никуда.", 4),
    ],
)
def test_lattices_of_texts_that_are_no_rulings(text, parts):
    assert len(cut(text)) == parts, cut(text)


def test_a_long_paragraph_takes_linear_time():
    import time

    took = []
    for n in (2_000, 8_000):
        text = "He said (it is “so. And so”) and left. " * n + "\nCourt | Page 2 of 3\n" + "more of it. " * n
        began = time.perf_counter()
        assert len(cut(text)) > n
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.5


def test_layout_of_a_document():
    text = "A v. B\nCourt\nAA 1/2\n\n\nREASONS\n\n1. The first one\nwraps here. It goes on over\nCourt | Page 2 of 3\nthe page. See fig.\n2.5 there.\n- 3 -\n\n\n2. Last.\n\nSigned: Me"
    got = [text[a : a + 8] for a in sentences.starts(text)]
    assert got == ["A v. B\nC", "Court\nAA", "AA 1/2\n\n", "REASONS\n", "1. The f", "It goes ", "Court | ", "See fig.", "- 3 -\n\n\n", "2. Last.", "Signed: "]


def test_rules_come_from_the_whole_text_and_its_paragraphs():
    quoted = "The judge said that it was late and that the claim of the owner was to fail. " * 30
    german = "Das wird nach § 3 Anm. 75 nicht entschieden. " * 120
    assert sentences.language(quoted + "\n\n" + german) == ("de", True) and len(cut(quoted + "\n\n" + german)) == 150
    thai = "ศาลเห็นว่าพ้นกำหนดเวลาแล้ว ให้ยกคำร้อง"
    parts = cut("\n\n".join([quoted, thai, quoted, thai, quoted]))
    assert parts.count("ให้ยกคำร้อง") == 2 and len(parts) == 94
    assert len(cut("\n\n".join([thai] * 9 + [quoted[:77].strip() + " The end."]))) == 1 + 16 + 2  # the first is a caption


def test_captions_end_by_layout():
    lines = [f"Party {i} of the ship" for i in range(11)] + ["Court of " + "the sea " * 16]
    body = "\n\n\nREASONS\n\nIt ended. It began."
    assert len(cut("\n".join(lines) + body)) == 12 + 3
    wrapped = "\n".join(["It was said that the ship", "had left the port. It was", "late and"] * 4)
    assert len(cut(wrapped + "\n\n\nThe end.")) == 1 + 4 + 1


def test_sentences_of_odd_documents(spark):
    docs = [(1, None), (2, ""), (3, " \n "), (4, "One. Two."), (5, "Word " * 50000 + "end. Next."), (6, "“open (quote. Still")]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id bigint, text string, start_pos int")
    got = sentences.sentences(df.drop("start_pos")).groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == {4: 2, 5: 2, 6: 1}
