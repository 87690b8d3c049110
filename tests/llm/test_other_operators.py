"""Embedding near-dedup, decontamination, token counts, LM scoring and HTML text."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronika.llm import bpe, decontaminate, html_text, lm_scoring, neardup_embeddings, token_counts
from tests.llm.cases import none, odd, odd_rows


def brute_links(rows, cosine=0.98):
    usable = lambda v, label, e: v is not None and label is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)
    near = [set() for _ in rows]
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if usable(*a) and usable(*b) and a[1] == b[1] and len(a[2]) == len(b[2]):
                x, y = np.array(a[2]), np.array(b[2])
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= cosine:
                    near[i].add(j)
                    near[j].add(i)
    component = [r[0] for r in rows]
    for i in sorted((k for k in range(len(rows)) if rows[k][0] is not None), key=lambda k: rows[k][0]):
        todo, seen = [i], {i}
        while todo:
            for k in near[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        for k in seen:
            component[k] = min(component[k], rows[i][0]) if component[k] is not None else None
    return sorted(((r[0], len(near[i]), component[i]) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("leaf_rows", [2048, 40])
def test_embeddings_equal_brute_force(spark, leaf_rows):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    rows = [(i, int(rng.integers(3)), [float(np.float32(x)) for x in base[rng.integers(40)] + rng.standard_normal(16) * rng.choice([0, 0.02, 0.1, 0.3])]) for i in range(300)]
    rows += [(600, None, rows[0][2]), (601, 0, None), (602, 0, [0.0] * 16), (603, 0, [None] + [1.0] * 15), (604, 0, [float("nan")] + [1.0] * 15), (605, 0, []), (606, 0, [1.0, 2.0]), (607, 0, [2.0, 4.0]), rows[5], (None, 0, rows[1][2])]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, rep string, n int")
    found = neardup_embeddings.near_duplicates(frame, leaf_rows=leaf_rows)
    assert sorted((tuple(r)[:3] for r in found.collect()), key=str) == brute_links(rows)
    assert all(r.kept == (r.vec_id == r.component) for r in found.collect())


@pytest.mark.parametrize(("rows", "leaf_rows"), [(6000, 2048), (3000, 100)])
def test_dense_cluster_keeps_all_links(spark, rows, leaf_rows):
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(64)
    centre /= np.linalg.norm(centre)
    x = np.concatenate([centre + rng.standard_normal((rows - 500, 64)) * 0.0165, rng.standard_normal((500, 64))]).astype(np.float32)
    near = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = [int((near[i] @ near.T >= 0.98).sum()) - 1 for i in range(rows)]
    assert sum(want) > 0.5 * (rows - 500) ** 2
    frame = spark.createDataFrame([(i, 1, v) for i, v in enumerate(x.tolist())], "vec_id long, label int, embedding array<float>")
    found = {r.vec_id: r for r in neardup_embeddings.near_duplicates(frame, leaf_rows=leaf_rows).collect()}
    assert [found[i].n_links for i in range(rows)] == want
    assert {found[i].component for i in range(rows) if want[i]} == {min(i for i in range(rows) if want[i])}


def test_no_embeddings(spark):
    assert neardup_embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).count() == 0


QUESTION = "If Alice buys 12 apples and Bob has 7 kg of pears then Alice pays 30 dollars in total for the market day"


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("before it. " + QUESTION + " after", True),
        (QUESTION.upper().lower(), True),
        ("so if Carol buys 99 apples and Dave has 3 lb of pears then Carol pays 31 euros in total for the market day ok", True),
        ("if Carol buys 99 apples and Dave has 3 lb of pears then Eve pays 31 euros in total for the market day", False),
        (QUESTION[:50], False),
        (" ".join(reversed(QUESTION.split())), False),
        ("", False),
        (None, False),
        ("7 " * 50, False),
    ],
)
def test_templates(text, found):
    items = decontaminate.Items([(1, QUESTION), (2, "1 2 3 4 5 6 7"), (3, "")], 5)
    assert [i for i, *_ in items.found(text, 0.8)] == [1] * found


STORY = "Anna has 3 apples in a basket. Ben gives her 4 more from the garden. Anna eats 2 of them at noon. How many are left for Ben at night?"


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (STORY, True),
        ("Carla has 8 apples in a basket. Dan gives her 9 more from the garden. Carla eats 5 of them at noon. How many are left for Dan at night?", True),
        ("as was said before Carla has 8 apples in a basket. Dan gives her 9 more from the garden. Carla eats 5 of them at noon. How many are left for Dan at night?", True),
        ("Carla has 8 apples in a basket. Dan gives her 9 more from the garden. Eve eats 5 of them at noon. How many are left for Finn at night?", False),
    ],
)
def test_names_at_sentence_starts(text, found):
    assert [i for i, *_ in decontaminate.Items([(1, STORY)], 5).found(text, 0.8)] == [1] * found


@pytest.mark.parametrize(
    ("text", "found"),
    [("12 + 7 = 19", [1]), ("so:\n 12 +7= 19\nend", [1]), ("it is 12 + 7 = 19 here", [1]), ("13 + 7 = 20", [1]), ("it is 13 + 7 = 20 here", []), ("7 + 7 = 20", []), ("12 - 7 = 19", []), ("112 + 7 = 19", [1]), ("at 12 + 7 = 190 here", []), ("42", [2]), ("in 42 days", []), ("12 7 19", []), ("?!", [3]), ("", []), (None, [])],
)
def test_items_without_a_template(text, found):
    """Bare numbers are found as whole lines only, sums inside of lines too, and as whole lines with other numbers."""
    items = decontaminate.Items([(1, "12 + 7 = 19"), (2, "42"), (3, "? !"), (4, " ")], 5)
    assert [i for i, *_ in items.found(text, 0.8)] == found


SHORT = ["Name the capital.", "Which river is longest?", "Add 5 apples", "solve it", "Paris", "Where is Rome"]


@pytest.mark.parametrize("before", ["", "Many words stand here now. ", "Many words stand here now.\n", "and so "])
@pytest.mark.parametrize("after", ["", "\nAnd more words follow after it.", " and then more words follow"])
def test_short_items_are_found_wherever_they_stand(before, after):
    items = decontaminate.Items(list(enumerate(SHORT)), 5)
    for k, item in enumerate(SHORT):
        text = before + item + after
        alone = before in ("", "Many words stand here now.\n") and not after.startswith(" ")
        assert (k in [i for i, *_ in items.found(text, 0.8)]) == (item != "Paris" or alone), (item, text)


@pytest.mark.parametrize(
    ("text", "want"),
    [("name a capital of it", []), ("Visit the capital today", []), ("please add 9 apples now", [2]), ("Tell us where is Oslo then", [5]), ("resolve it", []), ("which is the longest river", []), ("Parisian life in Paris now", [])],
)
def test_short_items_are_not_found_elsewhere(text, want):
    assert [i for i, *_ in decontaminate.Items(list(enumerate(SHORT)), 5).found(text, 0.8)] == want


def test_items_of_all_lengths_equal_brute_force():
    """Each item stands where its words follow each other, and nowhere else, whatever its length."""
    rng = random.Random(8)
    words = "red hill lake stone bird mill road barn well gate".split()
    for _ in range(60):
        items = [" ".join(rng.choices(words, k=rng.randrange(2, 9))) for _ in range(6)]
        text = " ".join([*rng.choices(words, k=rng.randrange(12)), rng.choice(items), *rng.choices(words, k=rng.randrange(12))])
        got = {i for i, *_ in decontaminate.Items(list(enumerate(items)), 5).found(text, 1.0)}
        assert got == {i for i, x in enumerate(items) if f" {x} " in f" {text} "}


def test_slots_go_one_to_one():
    items = decontaminate.Items([(1, "In this tale Anna meets Ben before Anna and Ben walk home with Carl to count 5 stones and 5 shells")], 5)
    tale = "In this tale {} meets {} before {} and {} walk home with {} to count {} stones and {} shells"
    for names, want in ((("Dora", "Emil", "Dora", "Emil", "Fred", 7, 7), [1]), (("Dora", "Emil", "Dora", "Fred", "Fred", 7, 7), []), (("Dora", "Dora", "Dora", "Dora", "Fred", 7, 7), []), (("Dora", "Emil", "Dora", "Emil", "Emil", 7, 7), [])):
        assert [i for i, *_ in items.found(tale.format(*names), 0.8)] == want


def slow_found(item, text, n=5, coverage=0.8):
    """Whether item's plain template stands in the text: for each offset, the share of its windows that agree there."""
    units = set(decontaminate.UNITS)

    def template(x):
        out = []
        for w in decontaminate.TOKEN.findall(x.lower()):
            if w not in ".!?:\n":
                out.append("<num>" if w[0].isdigit() else "<unit>" if w in units and out and out[-1] == "<num>" else w)
        return out

    a, b = template(item), template(text)
    says = lambda w: sum(x not in ("<num>", "<unit>") for x in w) >= 2
    mine = [j for j in range(len(a) - n + 1) if says(a[j : j + n])]
    return bool(mine) and any(sum(b[j + o : j + o + n] == a[j : j + n] for j in mine if j + o >= 0) >= coverage * len(mine) for o in range(-len(a), len(b)))


def test_plain_templates_equal_brute_force():
    """Lower-case texts without repeated numbers, so that names and slots decide nothing."""
    rng = random.Random(6)
    words = "a man was seen at the old mill by two of his men who told it to all in town that night".split()
    for _ in range(150):
        item = [rng.choice(words) if rng.random() < 0.85 else str(rng.randrange(100, 10**6)) for _ in range(rng.randrange(8, 30))]
        text = list(item)
        for k in range(len(text)):
            if rng.random() < rng.choice([0, 0.02, 0.05]):
                text[k] = rng.choice(words)
            elif text[k][0].isdigit():
                text[k] = str(rng.randrange(100, 10**6))
        text = [*rng.choices(words, k=rng.randrange(9)), *text, *rng.choices(words, k=rng.randrange(9))]
        item, text = " ".join(item), " ".join(text)
        assert bool(decontaminate.Items([(1, item)], 5).found(text, 0.8)) >= slow_found(item, text)
        other = " ".join(rng.choices(words, k=40))
        assert slow_found(item, other) == bool(decontaminate.Items([(1, item)], 5).found(other, 0.8)) == False  # noqa: E712


def test_planted_passages_and_blocks(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    texts = {r.item_id: r.text for r in bench.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in texts.items() if t in r.text}
    one = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()}
    many = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench, block_windows=300).collect()}
    assert want <= one and len(one) <= len(want) + 2 and one == many
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len({d for d, _ in one})


def test_decontamination_of_odd_rows(spark):
    bench = spark.createDataFrame([(1, odd_rows()[0][1]), (1, odd_rows()[0][1]), (2, None), (None, "x"), (3, "")], "item_id long, text string")
    found = decontaminate.matches(odd(spark), bench).collect()
    assert {r.doc_id for r in found if r.item_id == 1} == {1, 2, 3, None}
    assert decontaminate.matches(none(spark), bench).count() == 0
    assert decontaminate.clean(odd(spark), bench.limit(0)).count() == odd(spark).count()


def test_counts_follow_edits():
    tokenizer = bpe.ByteBpe(bpe.default_tokenizer_path())
    rng = random.Random(2)
    parts = [*"ab 's\n\t1é.<|>", "<|endoftext|>", "endoftext", "  ", "'re", "hello", " world"]
    for _ in range(400):
        counted = token_counts.CountedText("".join(rng.choice(parts) for _ in range(rng.randint(0, 60))), tokenizer)
        text = counted.text
        for _ in range(8):
            start = rng.randint(0, len(text) + 2)
            end, new = start + rng.randint(-1, 6), "".join(rng.choice(parts) for _ in range(rng.randint(0, 5)))
            counted.replace(start, end, new)
            start = min(start, len(text))
            text = text[:start] + new + text[max(start, min(end, len(text))) :]
            assert counted.text == text and counted.n_chars == len(text)
            assert counted.n_tokens == len(tokenizer.encode(text))


def test_crowded_leaves_are_dealt_out_without_encoding():
    tokenizer = bpe.ByteBpe(bpe.default_tokenizer_path())
    counted = token_counts.CountedText("one two three four five six seven " * 300, tokenizer)
    before, put = counted.encoded, "new words here " * 200
    counted.replace(200, 205, put)
    assert counted.encoded - before < len(put) + 400 and all(isinstance(x, str) for x in counted.slots)
    for start in (100, 1500, 3000, 0):
        counted.replace(start, start + 3, "<x>")
    assert counted.n_tokens == len(tokenizer.encode(counted.text)) and counted.n_chars == len(counted.text)


def test_null_offsets_are_no_edits(spark):
    rows = [(1, "some words", [(0, None, "x"), (None, 2, "y"), None, (0, 4, None), (0, 0, "few")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:int,end:int,text:string>>")
    got = token_counts.edited_counts(docs, edits_col="edits").first()
    assert (got.n_edits, got.n_tokens_after) == (2, len(bpe.ByteBpe(bpe.default_tokenizer_path()).encode("few words")))


def test_edits_touch_little_of_a_long_text():
    tokenizer = bpe.ByteBpe(bpe.default_tokenizer_path())
    counted = token_counts.CountedText("some words of a text " * 5000, tokenizer)
    before = counted.encoded
    counted.replace(50_000, 50_005, "others")
    assert counted.encoded - before < 200


def test_edited_counts_of_odd_rows(spark):
    tokenizer = bpe.ByteBpe(bpe.default_tokenizer_path())
    rows = token_counts.edited_counts(odd(spark)).collect()
    assert len(rows) == odd(spark).count() and token_counts.edited_counts(none(spark)).count() == 0
    given = spark.createDataFrame([(1, "mail a@b.org or 10.0.0.1", [(5, 12, "X"), (0, 4, None)]), (2, None, None), (3, "ab", [])], "doc_id long, text string, edits array<struct<start:int,end:int,text:string>>")
    found = {r.doc_id: r for r in token_counts.edited_counts(given, edits_col="edits").collect()}
    assert found[1].n_tokens_after == len(tokenizer.encode(" X or 10.0.0.1")) and found[1].n_edits == 2 and found[2].n_tokens == 0
    masked = {r.doc_id: r for r in token_counts.edited_counts(given).collect()}
    assert masked[1].n_tokens_after == len(tokenizer.encode("mail <email> or <ip>"))


def split_tokens(text):
    out, last = [], 0
    for b in (text or "").encode():
        kind = int(lm_scoring.KIND[b])
        if kind and kind == last:
            out[-1] += bytes([int(lm_scoring.LOWER[b])])
        elif kind:
            out.append(bytes([int(lm_scoring.LOWER[b])]))
        last = kind
    return out


class SlowModel:
    """Counts of some texts, each one's loss without its own share."""

    def __init__(self, texts, ids, vocabulary):
        self.texts, self.ids, self.size = texts, ids, vocabulary + 2
        self.sums = [Counter(), Counter(), Counter()]
        for i in ids:
            for c, own in zip(self.sums, self.counts(texts[i])):
                c.update(own)

    def counts(self, words):
        before = ["<s>", *words[:-1]][: len(words)]
        return Counter(words), Counter(before), Counter(zip(before, words))

    def loss(self, i):
        words = self.texts[i]
        own = self.counts(words) if i in self.ids else (Counter(),) * 3
        uni, context, pair = ({k: c[k] - o[k] for k in self.counts(words)[n]} for n, (c, o) in enumerate(zip(self.sums, own)))
        total, out, before = sum(self.sums[0].values()) - sum(own[0].values()), 0.0, "<s>"
        for w in words:
            mix = lm_scoring.MIX if context[before] else 0
            out -= math.log(mix * pair[before, w] / max(context[before], 1) + (1 - mix) * (uni[w] + lm_scoring.ALPHA) / (total + lm_scoring.ALPHA * self.size))
            before = w
        return out / max(len(words), 1)


def test_scores_equal_brute_force(spark):
    texts = {1: "The cat sat. The cat ran!", 2: "the dog sat", 3: "", 4: None, 5: "zebra ### zebra", 6: "The cat sat. The cat ran!"}
    words = {i: split_tokens(t) for i, t in texts.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("near", F.col("doc_id").isin(1, 2)).withColumn("b", F.lit("other"))
    size = len({w for x in words.values() for w in x})
    near, far = SlowModel(words, {1, 2}, size), SlowModel(words, set(texts), size)
    got = {r.doc_id: r for r in lm_scoring.score(docs, in_target="near").collect()}
    for i in texts:
        assert got[i].n_tokens == len(words[i])
        assert got[i].target_loss == pytest.approx(near.loss(i)) and got[i].background_loss == pytest.approx(far.loss(i))
        assert got[i].score == pytest.approx(far.loss(i) - near.loss(i))
    assert got[6].background_loss < got[5].background_loss - 1  # its copy tells
    # Other texts as models: nothing is left out.
    near, far = SlowModel({**words, 7: words[1], 8: words[5]}, {7}, len(set(words[1]) | set(words[5]))), SlowModel({**words, 7: words[1], 8: words[5]}, {7, 8}, len(set(words[1]) | set(words[5])))
    got = {r.doc_id: r for r in lm_scoring.score(docs, docs.filter("doc_id = 1"), docs.filter("doc_id in (1, 5)")).collect()}
    for i in texts:
        assert got[i].target_loss == pytest.approx(near.loss(i)) and got[i].background_loss == pytest.approx(far.loss(i))


def test_no_bigram_is_cut(spark):
    """More than 200,000 distinct bigrams, in several chunks and shards."""
    rng = random.Random(4)
    texts = {i: " ".join(f"w{rng.randrange(60_000)}" for _ in range(20_000)) for i in range(12)}
    words = {i: t.split() for i, t in texts.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("near", F.col("doc_id") < 2).repartition(3, "doc_id")
    got = {r.doc_id: r for r in lm_scoring.score(docs, in_target="near").collect()}
    size = len({w for x in words.values() for w in x})
    assert size > 55_000
    near, far = SlowModel(words, {0, 1}, size), SlowModel(words, set(words), size)
    for i in (0, 5):
        assert got[i].target_loss == pytest.approx(near.loss(i)) and got[i].background_loss == pytest.approx(far.loss(i))


def test_scores_of_odd_rows_and_separation(spark):
    rows = lm_scoring.score(odd(spark), none(spark)).collect()
    assert len(rows) == odd(spark).count() and all(math.isfinite(r.score) for r in rows)
    assert lm_scoring.score(none(spark), none(spark)).count() == 0
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = lm_scoring.score(docs, docs.join(labels.filter("quality = 1 and doc_id % 2 = 0"), "doc_id", "left_semi")).join(labels.filter("doc_id % 2 = 1"), "doc_id")
    means = {r.quality: r["avg(score)"] for r in held.groupBy("quality").avg("score").collect()}
    assert means[1] > means[0]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("a  b\n c", "a b c"),
        ("<p>One<p>Two", "One\n\nTwo"),
        ("<head><title>T</title><style>x{}</style></head><body>shown</body>", "shown"),
        ("<div hidden>a</div><div style='display : none'>b</div><span style='visibility:hidden'>c</span>d", "d"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>", "- a\n- b\n  3. x\n  4. y\n- c"),
        ("<table><tr><th>Name<th>Qty<tr><td>Apple pie<td>12</table>", "Name      | Qty\nApple pie | 12"),
        ("<table><td rowspan=2>r<td>1<tr><td>2</table>", "r | 1\n  | 2"),
        ("<table><tr><td>a<td>b<tr><td colspan=2>wide one</table>", "a | b\nwide one"),
        ("x<br>y<pre> 1\n  2</pre>z", "x\ny\n\n 1\n  2\n\nz"),
        ("<script>var a = '</p>' < 1;</script>&amp;&lt;&copy;", "&<©"),
        ("1 < 2 <a href='x>y'>link</a>", "1 < 2 link"),
        ("<b>bold<p>para</b> more", "bold\n\npara more"),
        ("<!-- c --><p>a<!-- open", "a"),
        ("<dl><dt>T<dd>D</dl>", "T\n  D"),
    ],
)
def test_layout(page, text):
    assert html_text.visible_text(page) == text


def test_layout_of_broken_markup(spark):
    for page in ("<", "<a", "<a href='", "</", "<!", "<!--", "<p" * 5000, "<div>" * 5000 + "x", "<table>" * 500 + "x", "&#999999999;", "</p></p>x", "<td>x", "<script>never closed"):
        html_text.visible_text(page)
    frame = spark.createDataFrame([(1, None, "x"), (1, "<p>a", "y"), (None, "<p>b", None)], "page_id long, html string, id string")
    assert sorted(r.text for r in html_text.extract(frame).collect()) == ["", "a", "b"]
    assert html_text.extract(frame.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div style='display:none;display:block'>a</div>", "a"),
        ("<div style='display:none !important;display:block'>a</div>b", "b"),
        ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b>c<i style='visibility:inherit'>d</i></div>e", "b\ne"),
        ("<p style='background-image:url(display:none)'>a</p>", "a"),
        ("<details><summary>s</summary>a<p>b</p></details><details open>c</details>", "s\nc"),
        ("x<textarea>a  b &amp; <c></textarea>y", "x\n\na  b & <c>\n\ny"),
        ("<select><option>a<option>b</select>", "a\nb"),
        ("<math><mi>x</mi><mo>=</mo><mn>1</mn></math> <svg><title>t</title><text>s</text></svg>", "x=1 s"),
        ("<div>" * 300 + "<p>a<div hidden>b<b>c</b></div>d<p style='visibility:hidden'>e</p>" + "</div>" * 300 + "f", "a\nd\nf"),
        ("<div hidden>" + "<div>" * 300 + "a" + "</div>" * 301 + "b", "b"),
        ("<table><tr><td colspan=900>a<td>b<tr><td>c<td colspan=899>d<td>e</table>", "a     | b\nc | d | e"),
    ],
)
def test_visibility(page, text):
    assert html_text.visible_text(page) == text


def some_html(rng, depth, shown=True, gone=False):
    """A well-formed random page and its visible words, in order."""
    page, words = [], []
    for _ in range(rng.randrange(1, 5)):
        if depth == 0 or rng.random() < 0.4:
            word = f"w{rng.randrange(10**9)}"
            page.append(f" {word} ")
            words += [word] * (shown and not gone)
            continue
        tag = rng.choice(["div", "span", "section", "b", "em", "ul", "template", "details", "article"])
        style, now, lost = rng.choice([("", shown, False), ("", shown, False), (" hidden", shown, True), (" style='display: none'", shown, True), (" style='visibility:hidden'", False, False), (" style='color:red;visibility:visible'", True, False)])
        lost = gone or lost or tag in ("template", "details")
        inside, more = some_html(rng, depth - 1, now, lost)
        if tag == "ul":
            inside = f"<li>{inside}</li>"
        page.append(f"<{tag}{style}>{inside}</{tag}>")
        words += more
    return "".join(page), words


def test_visible_words_once_and_in_order():
    rng = random.Random(12)
    for k in range(300):
        page, words = some_html(rng, rng.choice([2, 4, 6]))
        page = "<div>" * (k % 3 * 197) + page  # the deepest ones go beyond MAX_DEPTH
        assert [w for w in html_text.visible_text(page).split() if w != "-"] == words


def test_many_open_tags_and_wide_cells_stay_cheap():
    assert html_text.visible_text("<font>" * 50_000 + "a</p>b" + "<p>c" * 1000).split()[:2] == ["ab", "c"]
    assert html_text.visible_text("<table>" + "<tr><td colspan=1000 rowspan=9>x<td>y" * 2000).count("y") == 2000
