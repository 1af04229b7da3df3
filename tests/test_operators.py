"""Operators of the campaign engine on small fixtures: text forms, ladders, the decision table, binding."""

import datetime as dt
import itertools
import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from postcheck.functions import coerce, forms, similarity, urls
from postcheck.operators import adjudicate, efficiency, evaluate, links, manifest, match, output, remap
from postcheck.sources import bind

#: The first 20 of the 24 hexadecimal characters of post and author ids.
N, A = "0c0ffee0" * 2 + "77aa", "badc0de1" * 2 + "e5e5"


def _one(spark, c, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(c.alias("v")).first()["v"]


def test_forms(spark):
    cases = [("月亮船🌙", "月亮船", "月亮船"), ("Ｐomelo Talk 小柚", "pomelotalk小柚", "小柚"), ("momo_", "momo_", ""), ("🌙🌙", "", ""), ("Straße", "strasse", ""), (None, "", "")]
    df = forms.add_forms(spark.createDataFrame([(c[0],) for c in cases], "name string"), "name", "f_")
    got = {r["name"]: (r["f_norm"], r["f_cjk"], r["f_ascii"]) for r in df.collect()}
    for name, normed, han in cases:
        assert got[name][:2] == (normed, han)
    assert got["momo_"][2] == "momo"
    assert _one(spark, forms.header_key(F.col("x")), x="FAN BASE（K)") == "fanbase(k)"
    assert _one(spark, forms.is_hex24(F.col("x")), x=f" {N}a001 ") is True


def _common(a, b):
    """Length of the longest common subsequence, by the textbook table over all prefixes."""
    above = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[j]))
        above = row
    return above[-1]


def _defined_ratio(a, b):
    """The partial ratio part by part, as it is defined."""
    if not a or not b:
        return 0.0
    orders = [(a, b), (b, a)] if len(a) == len(b) else [tuple(sorted((a, b), key=len))]
    parts = ((s, l[max(0, i) : i + len(s)]) for s, l in orders for i in range(1 - len(s), len(l)))
    return max(200 * _common(s, p) / (len(s) + len(p)) for s, p in parts)


def test_partial_ratio():
    draw = random.Random(0)
    text = lambda least, most, letters: "".join(draw.choice(letters) for _ in range(draw.randint(least, most)))
    pairs = [("momok", "momokkk"), ("", "abc"), ("abcd", "abcd"), ("", ""), ("柚🌙茶", "x柚🌙🌙茶y"), ("a", "b" * 40), ("ab" * 30, "ba" * 90)]
    pairs += [(text(0, 7, "abc"), text(0, 7, "abc")) for _ in range(400)] + [(text(5, 20, "abcdef柚"), text(5, 60, "abcdef柚")) for _ in range(60)]
    got = similarity.partial_ratios(*map(list, zip(*pairs)))
    for (a, b), one in zip(pairs, got):
        assert abs(one - _defined_ratio(a, b)) < 1e-9, (a, b)
    assert got[0] == 100 and got[2] == 100 and got[1] == 0


def test_partial_ratio_in_blocks_and_of_long_texts(spark, monkeypatch):
    draw = random.Random(5)
    pairs = [("".join(draw.choice("abc") for _ in range(draw.randint(1, 9))), "".join(draw.choice("abc") for _ in range(draw.randint(1, 30)))) for _ in range(50)]
    whole = similarity.partial_ratios(*map(list, zip(*pairs)))
    monkeypatch.setattr(similarity, "CELLS", 40)
    assert (similarity.partial_ratios(*map(list, zip(*pairs))) == whole).all()
    needle, hay = "needle in the hay", "x" * 20000 + "needle on the hay" + "y" * 20000
    df = spark.createDataFrame([(needle, hay), (hay, needle), (None, needle), (needle, None)], "a string, b string")
    got = [r["v"] for r in df.select(similarity.partial_ratio(F.col("a"), F.col("b")).alias("v")).collect()]
    assert got[0] == got[1] and abs(got[0] - _defined_ratio(needle, "x" * 20 + "needle on the hay" + "y" * 20)) < 1e-9 and got[2:] == [0, 0]
    assert df.limit(0).select(similarity.partial_ratio(F.col("a"), F.col("b"))).isEmpty()


def test_contained_names_of_all_lengths(spark):
    draw = random.Random(9)
    word = lambda least, most: "".join(draw.choice("ab柚𠀀?") for _ in range(draw.randint(least, most)))
    names = sorted({word(0, 6) for _ in range(150)} | {"𠀀", "??", "a" * 9})
    shown = sorted({word(0, 14) for _ in range(120)} | {"𠀀柚", "?", "a" * 30, "𠀁𠀀"})
    make = lambda xs, key: spark.createDataFrame([(x, x) for x in xs] + [("null", None)], f"{key} string, norm string")
    got = [tuple(r) for r in match._contained(make(names, "l_id"), make(shown, "r_id"), "norm").collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in itertools.product(names, shown) if a and a in b}
    assert match._contained(make(names, "l_id").limit(0), make(shown, "r_id"), "norm").isEmpty()


def _joined_rows(plan) -> int:
    """Rows that the joins of an executed plan gave."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return _joined_rows(plan.executedPlan())
    if "QueryStage" in name:
        return _joined_rows(plan.plan())
    below = plan.children()
    own = plan.metrics().apply("numOutputRows").value() if "Join" in name else 0
    return own + sum(_joined_rows(below.apply(i)) for i in range(below.size()))


def test_names_that_share_all_their_pieces_are_joined_once(spark):
    """The numbers' pieces of four characters are few, so pairs that share one grow with the square of the names."""
    names = [f"k{1000000 + 7 * i}z" for i in range(1500)]
    make = lambda xs, key: spark.createDataFrame([(x, x) for x in xs], f"{key} string, norm string")
    hits = match._contained(make(names, "l_id"), make([f"{n}k1z" for n in names], "r_id"), "norm")
    got = [tuple(r) for r in hits.collect()]
    assert sorted(got) == [(n, f"{n}k1z") for n in names]
    assert _joined_rows(hits._jdf.queryExecution().executedPlan()) == len(names)


def test_contained_names_longer_than_the_pieces(spark):
    draw = random.Random(19)
    word = lambda least, most: "".join(draw.choice("ab柚𠀀") for _ in range(draw.randint(least, most)))
    shown = sorted({word(10, 40) for _ in range(60)} | {word(260, 420) for _ in range(6)} | {"ab" * 150, "x"})
    cut = lambda t, n: t[(at := draw.randint(0, max(0, len(t) - n))) : at + n]
    names = sorted({cut(draw.choice(shown), draw.choice((1, 3, 11, 12, 13, 14, 25, 200))) for _ in range(150)} | {"ab" * 8, "q" * 13, word(13, 13)})
    make = lambda xs, key: spark.createDataFrame([(x, x) for x in xs], f"{key} string, norm string")
    for some in (names, [n for n in names if len(n) > match.WHOLE], [n for n in names if len(n) <= match.WHOLE]):
        got = [tuple(r) for r in match._contained(make(some, "l_id"), make(shown, "r_id"), "norm").collect()]
        assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in itertools.product(some, shown) if a in b} and len(got) > 50


def test_name_hits_lose_no_pair(spark):
    draw = random.Random(1)
    word = lambda: "".join(draw.choice("abc柚茶") for _ in range(draw.randint(0, 7)))
    names, shown = sorted({word() for _ in range(80)}), sorted({word() for _ in range(80)})
    make = lambda xs, key: forms.add_forms(spark.createDataFrame([(x, x) for x in xs], f"{key} string, name string"), "name", "").select(key, "norm", "cjk", "ascii")
    left, right = make(names, "l_id"), make(shown, "r_id")
    got = {(r["l_id"], r["r_id"]): r["method"] for r in match.name_hits(left, right).collect()}
    f = {r[0]: r for r in left.collect()} , {r[0]: r for r in right.collect()}
    for a, b in itertools.product(names, shown):
        x, y = f[0][a], f[1][b]
        want = None
        if x["cjk"] and x["cjk"] in y["cjk"]:
            want = "cjk-substring"
        elif x["norm"] and x["norm"] in y["norm"]:
            want = "norm-substring"
        elif min(len(x["ascii"]), len(y["ascii"])) >= 4 and _defined_ratio(x["ascii"], y["ascii"]) >= 85:
            want = "ascii-fuzzy"
        assert got.get((a, b)) == want, (a, b)


def _posts(spark, rows):
    full = [(i, "T", *r) for i, r in enumerate(rows, 2)]
    return spark.createDataFrame(full, "excel_row int, campaign string, type_raw string, level_raw string, fanbase_raw double, mcn string, impression long, like_n long, collection long, comment_n long, ttl_engagement long, price double, cpm_src double, cpe_src double, post_link string")


def test_efficiency(spark):
    row = lambda t, l, f, p, i, e, m="x", link="": (t, l, f, m, i, e, 0, 0, e, p, None, None, link)
    rows = [row("报备", "腰部", 500.0, 10000.0, 100000, 1000), row("报备", "腰部", 500.0, 20000.0, 200000, 2000), row("软植", "", 450000.0, 9000.0, 0, 0, "X "), row("其他", "尾部", 5.0, 1.0, 1, 1, ""),
            row("报备", "KOC", 1.0, None, 1, 1), row("软植", "底部", 100.0, 5.0, 10, 1, "X", "http://a"), row("软植", "底部", 100.0, 5.0, 10, 1, "X", "http://a")]
    df = efficiency.flag_missing(efficiency.classify(_posts(spark, rows)))
    g = {r["grp"]: r for r in efficiency.group_metrics(df).collect()}
    assert set(g) == {"MID PAID", "MID SOFT", "BOT SOFT"}
    assert (g["MID PAID"]["n"], g["MID PAID"]["avg_price"], g["MID PAID"]["cpm_pooled"], g["MID PAID"]["cpe_pooled"]) == (2, 15000, 100, 10)
    assert g["MID SOFT"]["cpm_pooled"] is None and g["BOT SOFT"]["concentration_pct"] == 100
    codes = {r["code"] for r in efficiency.findings(df).collect()}
    assert codes == {"V2", "V3", "V6", "V7", "V8", "V9", "V11", "V12", "V13"}
    same = efficiency.compare_metrics(efficiency.group_metrics(df), efficiency.group_metrics_sql(df), ["grp"], ["n", "cpm_pooled", "spend", "concentration_pct"])
    assert same.count() == 0
    checks = efficiency.reconcile_totals(efficiency.group_metrics(df), efficiency.totals(df)).first()
    assert checks["rows_add_up"] and checks["shares_add_up"]
    fans = spark.createDataFrame([(x,) for x in (200.0, 201.0, 400.0, 401.0, 999.0, 1000.0, None)], "f double")
    assert [r["t"] for r in fans.select(efficiency.tier_of_followers(F.col("f"), efficiency.Config()).alias("t")).collect()] == ["KOC", "BOT", "BOT", "MID", "MID", "TOP", ""]


@pytest.mark.parametrize("text,want", [("2026-05-13", "2026-05-13"), ("2026/5/3", "2026-05-03"), ("2026.05.03", "2026-05-03"), ("5/13/2026", "2026-05-13"), ("13/5/2026", "2026-05-13"), ("2026-05-13 10:00:00", "2026-05-13"),
                                       ("5/13/75", "1975-05-13"), ("26-05-13", "2026-05-13"), ("27-05-13", None), ("2026.5.3 around noon", "2026-05-03"), ("x", None), ("", None)])
def test_dates(spark, text, want):
    got = _one(spark, coerce.parse_date(F.col("x"), F.lit("2026-08-01").cast("date")), x=text)
    assert (got and got.isoformat()) == want


def test_numbers_and_urls(spark):
    assert _one(spark, coerce.parse_int(F.col("x")), x="１，234.9") == 1234
    assert _one(spark, coerce.magnitude_int(F.col("x")), x="1.2万") == 12000 and _one(spark, coerce.magnitude_int(F.col("x")), x="3,001") == 3001
    assert _one(spark, coerce.magnitude_int(F.col("x")), x="1.23456w") == 12345 and _one(spark, coerce.magnitude_int(F.col("x")), x="x万") is None
    wide = coerce.parse_date(F.col("x"), F.lit("2026-08-01").cast("date"))
    assert str(_one(spark, wide, x="２０２６／０５／１３")) == "2026-05-13"
    assert _one(spark, urls.embedded_post_id(F.col("x")), x=f"https://r.org/{N}A00c?url=") == f"{N}a00c"
    roots = ("example.com",)
    good = f"https://www.example.com/explore/{N}A001?x=1"
    assert _one(spark, urls.post_id_from_url(F.col("x"), roots), x=good) == f"{N}a001"
    for bad in (good.replace("example.com", "example.com.evil.org"), good.replace("https", "ftp"), good.replace(".com/", ".com:81/"), "not a url"):
        assert _one(spark, urls.post_id_from_url(F.col("x"), roots), x=bad) is None


def test_bind_and_remap(spark):
    head = ["NO", "CAMPAIGN", "NAME", "POST DATE", "POST LINK", "LIKE"]
    body = [["1", "P1", "茶", "2026-05-13", "http://a/1", "1,200"], ["2", "", "柚", "2026/05/14", "", "3"], ["", "", "", "", "", "9"]]
    cells = [("w", "S", 1, r, c, v, None, None, None) for r, line in enumerate([["note"], head, *body], 1) for c, v in enumerate(line, 1) if v]
    df = spark.createDataFrame(cells, "workbook string, sheet string, sheet_no int, row int, col int, v_str string, v_num double, v_ts timestamp, link string")
    rows = bind.bind_tracker(df, F.lit("2026-08-01").cast("date")).orderBy("excel_row").collect()
    assert [(r["excel_row"], r["campaign"], r["name"], r["like_n"]) for r in rows] == [(3, "P1", "茶", 1200), (4, "P1", "柚", 3)]
    sigs = remap.candidate_signatures(df)
    assert sigs.count() == 5 and sigs.select("sig").distinct().count() == 5
    wrong = df.withColumn("v_str", F.when((F.col("row") == 2) & (F.col("col") == 3), "Kol").otherwise(F.col("v_str")))
    mapping = spark.createDataFrame([("w", "S", 2, {"name": 3, "post_link": 5})], "workbook string, sheet string, header_row int, columns map<string,int>")
    assert bind.bind_tracker(remap.apply_mapping(wrong, mapping, "tracker"), F.lit("2026-08-01").cast("date")).count() == 2
    p = spark.createDataFrame([(1, "S", 2, {"name": 3, "post_link": 3, "zz": 1, "no": 99})], "id int, sheet string, header_row int, columns map<string,int>")
    checked = remap.validate_proposal(p, "tracker", df)
    assert {r["field"]: r["col"] for r in checked.collect()} == {"name": 3, "post_link": None, "no": None}
    assert [(r["error"], r["what"]) for r in remap.validate_approval(checked, "tracker").collect()] == [("missing", "post_link")]


def test_answers_outputs_and_manifest(spark):
    item = '{"row":"a|1|r2","verdict":"SAME_POST","confidence":0.9,"rationale_en":"x","rationale_zh":"y"}'
    texts = [f"```json\n[{item}]\n```", f'ok {{"items":[{item}]}} bye', f"[{item},{item.replace('0.9', '9')}]", "nothing", item.replace("SAME_POST", "same"), f'{{"items":[{item.replace("0.9", "2")}]}} or rather [{item}]']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, answer string")
    assert sorted(r["id"] for r in adjudicate.parse_answers(df, "answer").collect()) == [0, 1]  # the last text has no reading that is good as a whole
    page = f'<script>window.__INITIAL_STATE__ = {{"note":{{"noteId":"{N}a001","user":{{"userId":"{A}00b1"}},"time":undefined}}}}</script>'
    pages = spark.createDataFrame([(page, f"{N}a001"), (page, f"{N}a002"), ("<html>", "")], "html string, want string")
    assert [r["state_note"] for r in links.extract_page_state(pages, "html", F.col("want")).collect()] == [f"{N}a001", None, None]
    base = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, x string, y int")
    patch = spark.createDataFrame([(2, {"y": None}), (3, {"x": "n"})], "k int, supplied map<string,string>")
    assert sorted(tuple(r) for r in output.merge_fields(base, patch, ["k"], ["x", "y"]).collect()) == [(1, "a", 5), (2, "b", None), (3, "n", None)]
    classes = {t: _one(spark, evaluate.classify_annotation(F.col("x")), x=t) for t in ("", "无博主（博主在Perimeter内）", "人工复核（链接已解析）", "check it", "名字错")}
    assert list(classes.values()) == ["MATCH", "无博主", "人工复核", "Check链接错误", match.MISLABEL]
    runs = spark.createDataFrame([("a", 5, 1, True), ("b", 5, 2, False), ("c", 5, 3, False)], "run_id string, bytes int, modified_at int, protected boolean")
    assert [r["run_id"] for r in manifest.over_budget(runs, 10).collect()] == ["b"]
    assert match.window_override(("2026-01-01", "2026-02-01"), "2026-03-01", "") == (dt.date(2026, 3, 1), None)


def test_registry_and_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 60


def test_walk_has_no_depth_bound(spark):
    deep = lambda n: '{"a":[' * n + '{"k":"x' + str(n) + '"}' + "]}" * n
    rows = [(n, deep(n)) for n in (0, 1, 2, 4, 6)] + [(99, "{}"), (98, None)]
    got = {r["id"]: r["k"] for r in links.walk(spark.createDataFrame(rows, "id int, json string"), "json", ("missing", "k"), "k").collect()}
    assert got == {0: "x0", 1: "x1", 2: "x2", 4: "x4", 6: "x6", 99: None, 98: None}


def test_page_state_in_every_shape(spark):
    note = f'{{"noteId":"{N}a001","title":"t","user":{{"userId":"{A}00b1"}},"interactInfo":{{"likedCount":"7"}}}}'
    shapes = [f'{{"noteData":{{"data":{{"noteData":{note}}}}}}}', f'{{"note":{{"noteDetailMap":{{"{N}a001":{{"note":{note}}}}}}}}}', f'{{"x":[{{"y":{{"z":[[{note}]]}}}}]}}', '{"x":1}']
    pages = spark.createDataFrame([(i, f"<script>window.__INITIAL_STATE__ = {s}</script>") for i, s in enumerate(shapes)], "id int, html string")
    got = {r["id"]: (r["state_note"], r["state_author"], r["state_title"], r["state_likes"]) for r in links.extract_page_state(pages, "html", F.lit(f"{N}a001")).collect()}
    assert [got[i] for i in range(4)] == [(f"{N}a001", f"{A}00b1", "t", 7)] * 3 + [(None, None, None, None)]


def test_unnamed_rows_count_as_blank(spark):
    lines = {2: ("n1", "http://a/1"), **{r: ("", "") for r in range(3, 212)}, 212: ("late", "http://a/2")}
    cells = [("w", "S", 1, 1, 1, "NAME"), ("w", "S", 1, 1, 2, "POST LINK"), ("w", "S", 1, 1, 3, "LIKE")]
    for r, (name, link) in lines.items():
        cells += [("w", "S", 1, r, c, v) for c, v in ((1, name), (2, link), (3, "7")) if v]
    df = spark.createDataFrame([(*c, None, None, None) for c in cells], "workbook string, sheet string, sheet_no int, row int, col int, v_str string, v_num double, v_ts timestamp, link string")
    assert [r["name"] for r in bind.bind_tracker(df, F.lit("2026-08-01").cast("date")).collect()] == ["n1"]


def test_links_join_normalised_and_good_ones_first(spark):
    tracker = spark.createDataFrame([(1, " x.org/a "), (2, "http://x.org/b"), (3, "http://x.org/c")], "excel_row int, post_link string")
    cache = [("http://x.org/a", "failed", "", "", 9), ("x.org/a", "ok", "n1", "u1", 1), ("http://x.org/b", "ok", "old", "u", 1), ("http://x.org/b", "ok", "new", "u", 2), ("http://x.org/c", "failed", "n", "u", 1)]
    got = match.attach(tracker, spark.createDataFrame(cache, "url string, status string, note_id string, author_id string, resolved_at int")).orderBy("excel_row").collect()
    assert [(r["note_id"], r["ok"]) for r in got] == [("n1", True), ("new", True), ("n", False)]


def test_digest_keeps_the_first_rows(spark):
    df = spark.createDataFrame([(k % 3, k) for k in range(60)] + [(0, 3)], "g int, excel_row int")
    got = {r["g"]: (r["total"], r["first_rows"]) for r in bind.digest(df, F.col("excel_row") > 2, "X", ("g",), 2).collect()}
    assert got == {0: (20, [3, 6]), 1: (19, [4, 7]), 2: (19, [5, 8])}
    assert [(r["total"], r["first_rows"]) for r in bind.digest(df, F.col("excel_row") > 57, "X").collect()] == [(2, [58, 59])]
    assert bind.digest(df, F.col("excel_row") > 99, "X").count() == 0


def test_finding_rows_and_counts_agree(spark):
    from postcheck.plans import efficiency as plans

    posts = plans.posts(spark, "/root/testdata/sf0.001")
    rows = efficiency.finding_rows(posts).groupBy("code", "severity", "detail").count().collect()
    counts = {(r["code"], r["detail"]): r["n"] for r in efficiency.findings(posts).collect() if r["code"] not in ("V6", "V8", "V9", "V10")}
    assert rows and {(r["code"], r["detail"]): r["count"] for r in rows} == counts


def test_payload_fields_in_any_nesting(spark):
    deep = f'{{"a":[1,{{"b":{{"c":{{"d":{{"e":{{"note_id":"{N}A001","userId":"u9","likes":"1.5万"}}}}}}}}}}]}}'
    df = spark.createDataFrame([(1, deep), (2, "{bad"), (3, None), (4, '{"id":"short","title":""}')], "k int, json string")
    got = {r["k"]: r for r in links.extract_note_fields(df, "json").collect()}
    assert (got[1]["note_id"], got[1]["author_id"], got[1]["likes"]) == (f"{N}a001", "u9", 15000)
    assert all(got[k]["note_id"] == got[k]["author_id"] == got[k]["title"] == "" and got[k]["likes"] is None for k in (2, 3, 4))


def test_passages_are_found_wherever_they_are(spark, monkeypatch):
    draw = random.Random(6)
    text = lambda n: "".join(draw.choice("abcdé漢") for _ in range(n))
    docs = [(i, text(draw.randint(0, 400))) for i in range(60)] + [(900, None), (901, "")]
    picks = [draw.choice([t for _, t in docs[:60] if len(t) > 60]) for _ in range(40)]
    needles = [(i, t[(at := draw.randint(0, len(t) - 50)) : at + draw.randint(1, 50)]) for i, t in enumerate(picks)] + [(100, text(30)), (101, None), (102, "")]
    make = lambda rows, key: spark.createDataFrame(rows, f"{key} int, norm string")
    got = sorted((r["l_id"], r["r_id"]) for r in match.contained_passages(make(needles, "l_id"), make(docs, "r_id"), "norm").collect())
    assert got == sorted((a, b) for a, x in needles for b, y in docs if x and y and x in y)


def _forms(spark, names, key):
    return forms.add_forms(spark.createDataFrame([(x, x) for x in names], f"{key} string, name string"), "name", "").select(key, "norm", "cjk", "ascii")


def test_fuzzy_blocking_loses_no_long_name(spark):
    draw = random.Random(4)
    word = lambda n: "".join(draw.choice("abcdefgh") for _ in range(n))

    def edited(s, n):
        for _ in range(n):
            i = draw.randrange(len(s))
            s = draw.choice((s[:i] + s[i + 1 :], s[:i] + draw.choice("abxy") + s[i:], s[:i] + draw.choice("abxy") + s[i + 1 :]))
        return s

    base = [word(draw.randint(4, 24)) for _ in range(60)]
    names = sorted({*base, "aaaaaaaa", "abababab"})
    shown = sorted({*(edited(s, draw.randint(0, 4)) or "q" for s in base), *(word(6) + edited(s, 2) + word(3) for s in base[:30]), "aaaaaaa", "aaaabaaaa", "babababab"})
    got = {(r["l_id"], r["r_id"]) for r in match.name_hits(_forms(spark, names, "l_id"), _forms(spark, shown, "r_id")).where("method = 'ascii-fuzzy'").collect()}
    want = {(a, b) for a, b in itertools.product(names, shown) if a not in b and min(len(a), len(b)) >= 4 and _defined_ratio(a, b) >= 85}
    assert got == want and len(want) > 20


def test_close_pairs_of_blocks_against_all_pairs(spark, monkeypatch):
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcd柚𠀀"[: draw.choice((2, 4, 6))]) for _ in range(draw.choice((4, 7, 12, 30, 64, 65, 80))))
    names = sorted({word() for _ in range(60)})
    shown = sorted({word() for _ in range(50)} | {x[: len(x) // 2] + "q" + x[len(x) // 2 + 1 :] for x in names})
    pairs = list(itertools.product(names, shown))
    want = {p for p, v in zip(pairs, similarity.partial_ratios(*map(list, zip(*pairs)))) if v >= 85}
    i, j = similarity.close_pairs(names, shown, 85.0)
    assert sorted((names[a], shown[b]) for a, b in zip(i, j)) == sorted(want)
    monkeypatch.setattr(match, "BLOCK", 20)
    make = lambda xs, key, form: spark.createDataFrame([(x, x) for x in xs], f"{key} string, {form} string")
    got = [tuple(r) for r in match._close_pairs(make(names, "l_id", "lf"), make(shown, "r_id", "rf"), 85.0).collect()]
    assert sorted(got) == sorted(want) and 100 < len(want) < len(pairs)
    assert match._close_pairs(make(names, "l_id", "lf").limit(0), make(shown, "r_id", "rf"), 85.0).isEmpty()


def test_few_pairs_are_compared_in_full(monkeypatch):
    """Names of one length over few letters share half of their bigrams with most others."""
    draw, compared, whole = random.Random(8), [], similarity.partial_ratios
    names = ["".join(draw.choice("etaoinsh") for _ in range(17)) for _ in range(300)]
    monkeypatch.setattr(similarity, "partial_ratios", lambda a, b: compared.extend(a) or whole(a, b))
    i, j = similarity.close_pairs(names, names, 85.0)
    assert {(k, k) for k in range(300)} <= set(zip(i.tolist(), j.tolist())) and len(compared) < 0.01 * 300 * 300


def test_blocks_of_names_do_not_meet_all_with_all():
    """Two blocks take less memory than one figure for each of their pairs."""
    draw = random.Random(9)
    names = ["".join(draw.choice("etaoinshrdlu") for _ in range(draw.randint(12, 20))) for _ in range(5000)]
    tracemalloc.start()
    i, j = similarity.close_pairs(names, names, 85.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {(k, k) for k in range(5000)} <= set(zip(i.tolist(), j.tolist())) and peak < 4 * 5000 * 5000


@pytest.mark.parametrize("letters, sizes, cutoff", [("ab", (4, 5, 6, 7, 8), 85), ("abcd柚", (9, 11, 12, 13, 14, 15), 85), ("abcdefgh", (17, 18, 20, 23), 85), ("abcd𠀀", (31, 33, 64, 65, 90), 85), ("etaoinsh", (4, 9, 17, 30), 91)])
def test_pairs_that_meet_by_pieces_against_all_pairs(spark, monkeypatch, letters, sizes, cutoff):
    """Edited names, ends that overlap only and names inside others; blocks of which too many meet are halved."""
    draw = random.Random(len(letters))
    word = lambda n: "".join(draw.choice(letters) for _ in range(n))

    def edited(s, n):
        for at in (draw.randrange(len(s)) for _ in range(n)):
            s = s[:at] + draw.choice(("", draw.choice(letters), draw.choice(letters) + s[at : at + 1])) + s[at + 1 :]
        return s

    names = sorted({word(draw.choice(sizes)) for _ in range(80)})
    shown = sorted({edited(x, draw.randint(0, 1 + len(x) // 5)) for x in names} | {x[draw.randint(0, len(x) // 3) :] + word(4) for x in names} | {word(3) + edited(x, 2) + word(2) for x in names[:40]})
    pairs = list(itertools.product(names, shown))
    want = {p for p, v in zip(pairs, similarity.partial_ratios(*map(list, zip(*pairs)))) if v >= cutoff}
    for meeting in (similarity.MEETING, 500):
        monkeypatch.setattr(similarity, "MEETING", meeting)
        got = [(names[a], shown[b]) for a, b in zip(*similarity.close_pairs(names, shown, float(cutoff)))]
        assert sorted(got) == sorted(want) and len(want) > 40
    monkeypatch.setattr(match, "BLOCK", 30)
    make = lambda key, form: spark.createDataFrame([(x, x) for x in names], f"{key} string, {form} string")
    one, two = (sorted(map(tuple, match._close_pairs(make("l_id", "lf"), make("r_id", "rf"), float(cutoff), same).collect())) for same in (False, True))
    assert one == two and {(x, x) for x in names} <= set(two)


def test_readings_of_chinese_names_rank_candidates(spark):
    lexicon = spark.createDataFrame([("柚", "you"), ("茶", "cha")], "char string, syllable string")
    left = forms.transliterate(_forms(spark, ["柚茶", "柚"], "l_id"), "cjk", lexicon, "pinyin")
    assert {(r["l_id"], r["r_id"], r["method"]) for r in match.name_hits(left, _forms(spark, ["YouCha77", "tea"], "r_id")).collect()} == {("柚茶", "YouCha77", "pinyin-bridge")}
    tracker = spark.createDataFrame([(2, "C", "1", "柚茶", dt.date(2026, 5, 1), "http://x/1")], "excel_row int, campaign string, no string, name string, post_date date, post_link string")
    export = spark.createDataFrame([(9, "YouCha77", "u1", "p1", dt.datetime(2026, 5, 2))], "excel_row int, blogger string, username string, post_id string, post_date timestamp")
    dead = spark.createDataFrame([("http://x/1", "failed", "", "")], "url string, status string, note_id string, author_id string")
    row = match.reconcile(tracker, export, dead, lexicon=lexicon).first()
    assert row["status"] == "LINK_ERROR" and [c["method"] for c in row["candidates"]] == ["pinyin-bridge"]
    assert match.reconcile(tracker, export, dead).first()["candidates"] == []


def test_series_differences(spark):
    schema = "chart string, series string, position long, value double"
    computed = spark.createDataFrame([("a", "x", 1, 1.0), ("a", "x", 2, None), ("a", "x", 3, 2.0), ("a", "x", 4, None), ("b", "y", 1, None)], schema)
    shown = spark.createDataFrame([("a", "x", 1, 1.0 + 1e-7), ("a", "x", 2, None), ("a", "x", 3, None), ("a", "x", 4, 5.0), ("a", "x", 9, 5.0)], schema)
    assert {(r["chart"], r["position"], r["problem"]) for r in efficiency.series_differences(computed, shown).collect()} == {("a", 3, "value differs"), ("a", 4, "value differs"), ("b", 1, "series missing")}
    assert efficiency.series_differences(computed, computed).isEmpty() and efficiency.series_differences(computed.limit(0), shown).isEmpty()


def test_settled_metrics_are_those_of_the_separate_operators(spark):
    draw = random.Random(5)
    some = lambda *xs: draw.choice(xs)
    rows = [(i, some("报备", "软植", "其他"), some("头部", "KOC", "", None), some(None, 50.0, 12000.0), some(None, "", " Ab", "ab", "AB ", "c"), some(None, 0, 0, 100, 100, 300, 700), 1, 1, 1, some(0, 5, 9), some(None, 1.25, 10.0, 99.5)) for i in range(200)]
    schema = "excel_row int, type_raw string, level_raw string, fanbase_raw double, mcn string, impression long, like_n long, collection long, comment_n long, ttl_engagement long, price double"
    table = lambda df: {tuple(r)[0]: tuple(r) for r in df.collect()}
    for p in (rows, rows[:3], []):
        posts = efficiency.flag_missing(efficiency.classify(spark.createDataFrame(p, schema)))
        for got, want in zip(efficiency.settled_metrics(posts), (efficiency.group_metrics(posts), efficiency.totals(posts), efficiency.agency_metrics(posts))):
            assert got.dtypes == want.dtypes
            one, two = table(got), table(want)
            assert set(one) == set(two) and all(one[k] == pytest.approx(two[k]) for k in one)


def test_series_differences_read_the_posts_twice(spark, monkeypatch):
    from postcheck.plans import QUERIES
    from postcheck.plans import efficiency as plans

    read, whole = spark.sparkContext.accumulator(0), plans.posts(spark, "/root/testdata/sf0.001")

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    monkeypatch.setattr(plans, "posts", lambda *_: whole.mapInPandas(counted, whole.schema))
    assert QUERIES["R8_series_differences"](spark, "/root/testdata/sf0.001").count() > 0
    assert read.value == 2 * whole.count()


def test_openings_against_brute_force(spark, tmp_path):
    from postcheck.plans import QUERIES

    texts = ["Red maple leaf falls", "Red mapple leaf", "  Blue\nriver bend here", "blue river", "柚 茶 店", "x", "", None, "Blue riverr bend"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["name"], r["other"]): r["method"] for r in QUERIES["P8_P9_fuzzy_names"](spark, str(tmp_path)).collect()}
    names = ["Red maple leaf", "Red mapple leaf", "Blue\nriver bend", "blue river", "柚 茶 店", "x", "Blue riverr bend"]
    plain = {n: "".join(n.split()).casefold() for n in names}
    want = {}
    for a, b in itertools.permutations(names, 2):
        if plain[a] in plain[b]:
            want[a, b] = "norm-substring"
        elif min(len(plain[a]), len(plain[b])) >= 4 and _defined_ratio(plain[a], plain[b]) >= 85:
            want[a, b] = "ascii-fuzzy"
    assert got == want and "ascii-fuzzy" in want.values() and "norm-substring" in want.values()


def test_missing_headers_looks_at_the_bound_sheet(spark):
    rows = [("a", "Cover", 1, 1, i, h) for i, h in enumerate(bind.EFFICIENCY.values(), 1)] + [("a", "MASTER KOL LIST", 2, 1, 1, "NO"), ("a", "MASTER KOL LIST", 2, 3, 1, "NAME"), ("a", "MASTER KOL LIST", 2, 3, 2, "PRICE")]
    cells = spark.createDataFrame([(*r, None, None, None) for r in rows], "workbook string, sheet string, sheet_no int, row int, col int, v_str string, v_num double, v_ts timestamp, link string")
    found = bind.missing_headers(cells, bind.EFFICIENCY).collect()
    assert len(found) == 1 and set(found[0]["missing"]) == set(bind.EFFICIENCY.values()) - {"name", "price"}
