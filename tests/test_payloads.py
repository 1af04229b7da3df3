"""Payload walks against their definition on random nestings."""

import json
import random

from pyspark.sql import functions as F

from postcheck.operators import links

KEYS = "abcd"


def _value(draw: random.Random, depth: int):
    kind = draw.randrange(9 if depth else 5)
    if kind < 5:
        return draw.choice(["", "x", "y1", None, 0, 7, 1.5, False, True, [], {}, "漢"])
    if kind < 7:
        return {k: _value(draw, depth - 1) for k in draw.sample(KEYS, draw.randint(0, 4))}
    return [_value(draw, depth - 1) for _ in range(draw.randint(0, 3))]


def _by_levels(value, keys):
    """Straight from the definition: all objects of one depth, in the order of the text, before the next depth."""
    level = [value]
    while level:
        below = []
        for node in level:
            if isinstance(node, dict):
                hits = [node[k] for k in keys if k in node and not (node[k] is None or node[k] == "" or node[k] == [] or node[k] == {})]
                if hits:
                    return hits[0]
                below += node.values()
            elif isinstance(node, list):
                below += node
        level = below
    return None


def test_walk_equals_definition(spark):
    draw = random.Random(5)
    values = [_value(draw, 5) for _ in range(400)]
    wanted = {"one": ("a",), "two": ("c", "b"), "none": ("q",)}
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(900, "{bad"), (901, None), (902, ""), (903, "[" * 100_000)], "id int, json string").withColumn("one", F.lit("old"))
    got = {r["id"]: r for r in links.find_first(df, "json", wanted).collect()}
    for i, v in enumerate(values):
        for out, keys in wanted.items():
            found = _by_levels(v, keys)
            text = found if found is None or isinstance(found, str) else json.dumps(found, ensure_ascii=False, separators=(",", ":"))
            assert got[i][out] == text, (v, out)
    assert all(got[i][out] is None for i in (900, 901, 902, 903) for out in wanted)
    assert sum(r["two"] is not None for r in got.values()) > 50


def test_one_job_whatever_the_depth(spark):
    df = spark.createDataFrame([(1, '{"a":' * 300 + '{"k":"deep"}' + "}" * 300)], "id int, json string")
    found = links.walk(df, "json", ("k",), "k")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.first()["k"] == "deep" and "Exchange" not in plan and "Join" not in plan and plan.count("ArrowEvalPython ") + plan.count("ArrowEvalPython[") <= 1


def test_falsy_values_give_way(spark):
    rows = ['{"interact_info":{"liked_count":0,"likedCount":"5"}}', '{"user":{"user_id":0,"id":"z"}}', '{"time":1.7e9}', '{"time":1700000000123}', '{"time":"1700000000"}', '{"user":"text","user_id":"u"}', '{"title":false}', '{"time":1e300}', '{"note_id":123456789012345678901234,"x":{"id":"ABCDEF0123456789abcdef00"}}', '{"interact_info":{"liked_count":"many"},"likes":"2w"}']
    got = {r["i"]: r for r in links.extract_note_fields(spark.createDataFrame(list(enumerate(rows)), "i int, json string"), "json").collect()}
    assert got[0]["likes"] == 5 and got[1]["author_id"] == "z"
    assert got[2]["published"] == "2023-11-14 22:13:20" == got[3]["published"] and got[4]["published"] == "1700000000"
    assert got[5]["author_id"] == "u" and got[6]["title"] == "" and got[7]["published"] == "1e+300"
    assert got[8]["note_id"] == "abcdef0123456789abcdef00" and got[9]["likes"] == 20000


def test_pages_of_other_posts_are_refused(spark):
    a, b, u = ("%024x" % i for i in (0xA1, 0xB2, 0xC3))
    page = lambda state: f"<p>a</p><script>window.__INITIAL_STATE__={state}</script>"
    post = f'{{"user":{{"userId":"{u}","nickName":"N"}},"time":undefined,"interactInfo":{{"liked_count":"3"}}}}'
    rows = [(1, page(f'{{"x":{post}}};'), a, a), (2, page(f'{{"x":{post}}}\n;;\n'), a, b), (3, page(f'{{"noteId":"{b}",' + post[1:]), a, ""), (4, page("{oops"), a, a), (5, None, a, a), (6, page(f'[{post}]'), a, a), (7, page(f'{{"p":{post},"q":{{"r":{post[:-1]},"id":"{a.upper()}","title":"last"}}}}}}'), a, None)]
    df = spark.createDataFrame(rows, "id int, html string, want string, landed string")
    got = {r["id"]: r for r in links.extract_page_state(df, "html", F.col("want"), F.col("landed")).collect()}
    assert (got[1]["state_note"], got[1]["state_author"], got[1]["state_name"], got[1]["state_likes"], got[1]["state_published"]) == (a, u, "N", 3, "")
    assert all(got[i]["state_note"] is None and got[i]["state_likes"] is None for i in (2, 3, 4, 5, 6))
    assert (got[7]["state_note"], got[7]["state_title"]) == (a, "last")
