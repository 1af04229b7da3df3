"""The decision table, one generated case for each of its branches, several of each, in random order."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from postcheck.operators import adjudicate, match, roster

TRACKER = "excel_row int, campaign string, no string, name string, post_date date, post_link string"
EXPORT = "excel_row int, blogger string, username string, post_id string, post_date timestamp"
CACHE = "url string, status string, note_id string, author_id string"
WINDOW = ("2030-01-01", "2030-12-31")


class Case:
    """What one tracker row is: its own post and author, the export's posts, and what the table makes of it."""

    def __init__(self, draw: random.Random, serial: int, kind: str) -> None:
        self.kind, self.serial = kind, serial
        # No two names resemble each other: each is its own pair of rare ideographs or a dozen random letters.
        self.name = chr(0x5200 + 3 * serial) + chr(0x7200 + 3 * serial) if serial % 2 else "".join(draw.choice("bcdfgjklmpqrstvwxz") for _ in range(12))
        self.note, self.author = f"post{serial:05d}", f"user{serial:05d}"
        self.date = dt.date(2030, 3, 1) + dt.timedelta(draw.randrange(200))
        self.link_ok, self.posts, self.more = True, [], []
        getattr(self, kind)(draw)

    def post(self, note: str, user: str, days: int = 0, blogger: str | None = None) -> None:
        self.posts.append((blogger or f"The {self.name} channel", user, note, self.date + dt.timedelta(days)))

    def matched(self, draw):
        self.post(self.note, self.author, draw.randint(-9, 9))
        self.want, self.best = ("MATCH", "1:note-id-join", ""), None

    def matched_under_another_name(self, draw):
        self.post(self.note, self.author, 0, f"elsewhere {self.serial}")
        self.want, self.best = ("MATCH", "1:note-id-join", ""), None

    def other_post_of_the_author(self, draw):
        self.post("other" + self.note, self.author, 4)
        self.post("nearer" + self.note, self.author, -2)
        self.want, self.best = ("NO_POST", "2:author-id", ""), "nearer" + self.note

    def author_under_another_name(self, draw):
        self.post("other" + self.note, self.author, 3, f"plain {self.serial}")
        self.post("late" + self.note, self.author, 30, f"plain {self.serial}")
        self.want, self.best = ("NO_POST", "2:author-id", ""), "other" + self.note

    def name_of_someone_else(self, draw):
        self.post("other" + self.note, self.author, 3, f"plain {self.serial}")
        self.post("foreign" + self.note, "x" + self.author, 1)
        self.want, self.best = ("REVIEW", "2:author-id+name-conflict", "foreign-name"), "foreign" + self.note

    def absent(self, draw):
        self.want, self.best = ("NO_BLOGGER", "2:author-id", ""), None

    def absent_with_a_namesake(self, draw):
        self.post("same" + self.note, "x" + self.author, 40)
        self.want, self.best = ("REVIEW", "2:author-id+name-conflict", "same-name"), "same" + self.note

    def no_author(self, draw):
        self.author = ""
        self.post("some" + self.note, "y", -7)
        self.want, self.best = ("REVIEW", "1:resolved-no-author", "no-author"), "some" + self.note

    def dead(self, draw):
        self.link_ok = False
        self.post("far" + self.note, "y", 8)
        self.want, self.best = ("LINK_ERROR", "3:name-heuristic", ""), None

    def dead_with_a_candidate(self, draw):
        self.link_ok = False
        for k, days in enumerate(draw.sample(range(-7, 8), 4)):
            self.post(f"c{days:+d}" + self.note, "y", days)
        self.posts.append((self.name, "y", "undated" + self.note, None))
        near = min((p for p in self.posts if p[3]), key=lambda p: (abs((p[3] - self.date).days), self.posts.index(p)))
        self.want, self.best = ("LINK_ERROR", "3:name-heuristic", ""), near[2]

    def author_by_sibling(self, draw):
        self.more = [(self.name, "sib" + self.note, self.author)]  # another row of the name, matched by its post
        self.post("sib" + self.note, self.author, 1)
        self.author = ""
        self.want, self.best = ("NO_POST", "2:author-id-sibling", ""), "sib" + self.note


KINDS = [k for k in vars(Case) if not k.startswith("_") and k != "post"]


@pytest.fixture(scope="module")
def world(spark):
    draw = random.Random(77)
    cases = [Case(draw, n + 1, kind) for n, kind in enumerate(KINDS * 3)]
    cases[KINDS.index("absent")].date = dt.date(2029, 2, 3)
    lines, posts, cache = [], [], []
    for c in draw.sample(cases, len(cases)):
        c.row = 10 + 7 * len(lines)
        entries = [(c.name, c.note, c.author, c.link_ok, c), *((*m, True, None) for m in c.more)]
        for name, note, author, ok, owner in entries:
            url = f"https://t.example/{c.serial}/{note}"
            lines.append((10 + 7 * len(lines), f"Wave {c.serial % 4}", str(c.serial), name, c.date, url))
            cache.append((url, "ok" if ok else "failed", note, author))
        posts += c.posts
    export = [(100 + i, b, u, p, d and dt.datetime.combine(d, dt.time(9))) for i, (b, u, p, d) in enumerate(posts)]
    frames = spark.createDataFrame(lines, TRACKER), spark.createDataFrame(export, EXPORT), spark.createDataFrame(cache, CACHE)
    verdicts = match.reconcile(*frames, WINDOW).cache()
    return cases, frames, verdicts, {r["excel_row"]: r for r in verdicts.withColumn("text", match.annotation(verdicts)).collect()}


def test_every_branch_of_the_decision_table(world):
    cases, _, _, got = world
    assert {c.kind for c in cases} == set(KINDS) and len(KINDS) == 11
    for c in cases:
        r = got[c.row]
        assert (r["status"], r["tier"], r["review_reason"]) == c.want, c.kind
        assert (r["candidates"][0]["post_id"] if r["candidates"] else None) == c.best, c.kind
        assert r["name_mislabel"] == (c.kind == "matched_under_another_name")
        assert r["out_of_window"] == (c.date.year == 2029)
        for x, y in zip(r["candidates"], r["candidates"][1:]):
            assert (x["delta"] is None, abs(x["delta"] or 0)) <= (y["delta"] is None, abs(y["delta"] or 0))
        if c.kind == "dead_with_a_candidate":
            assert len(r["candidates"]) == 5 and r["candidates"][-1]["post_id"].startswith("undated")
            assert r["text"] == f"Check链接错误（同名候选: The {c.name} channel {c.best} Δ={r['candidates'][0]['delta']}天）"
        if c.kind == "matched":
            assert r["text"] == "" and r["matched"]["delta"] == (c.posts[0][3] - c.date).days


def test_counts_audit_and_questions(world):
    cases, (tracker, export, _), verdicts, got = world
    counts = {r["status"]: r["n"] for r in match.status_counts(verdicts).collect()}
    assert counts["MATCH_name_mislabel"] == 3 and sum(n for s, n in counts.items() if s != "MATCH_name_mislabel") == tracker.count() == len(cases) + 3
    rows = match.reverse_audit(verdicts, export).collect()
    keys = [(r["blogger"], str(r["post_date"] or "")) for r in rows]
    matched = {r["matched"]["m_post"] for r in got.values() if r["matched"]}
    known = {r["author_id"] for r in got.values()} - {""}
    first, last = min(r["post_date"] for r in got.values()), max(r["post_date"] for r in got.values())
    want = {p for c in cases for _, u, p, d in c.posts if u in known and p not in matched and (d is None or first - dt.timedelta(1) <= d <= last + dt.timedelta(1))}
    assert keys == sorted(keys) and {r["post_id"] for r in rows} == want and len(want) > 5
    asked = adjudicate.questions(verdicts).collect()
    assert {r["question"] for r in asked} == {"same_person", "same_post"}


def test_rosters_split_the_absent(world, spark):
    cases, _, verdicts, _ = world
    absent = [c for c in cases if c.kind == "absent"]
    listed = lambda c, id: (40 + c.serial, "", c.name, id, 12)
    schema = "roster_row int, name string, namebis string, redbook_id string, followers int"
    micro = spark.createDataFrame([listed(absent[0], absent[0].author.upper())], schema)
    macro = spark.createDataFrame([listed(absent[1], "someone-else")], schema)
    split = {r["excel_row"]: r for r in roster.membership(verdicts, micro, macro).collect()}
    assert (split[absent[0].row]["status"], split[absent[0].row]["membership"]) == ("NO_POST_IN_PERIMETER", "micro")
    assert all(split[c.row]["status"] == "NO_BLOGGER_NOT_IN_PERIMETER" for c in absent[1:])
    notes = roster.name_evidence(roster.membership(verdicts, micro, macro), macro).collect()
    assert (absent[1].row, "near-miss") in {(r["excel_row"], r["note"]) for r in notes}


def test_export_without_usernames(world):
    cases, (tracker, export, cache), _, _ = world
    plain = {r["excel_row"]: r["tier"] for r in match.reconcile(tracker, export.withColumn("username", F.lit("")), cache).collect()}
    assert all(plain[c.row] == "2:no-username-column" for c in cases if c.kind in ("absent", "other_post_of_the_author"))


def test_no_cartesian_product_and_no_python(world):
    _, frames, _, _ = world
    plan = match.reconcile(*frames, ascii_only=True, fuzzy=False)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan


def test_frequent_names_keep_bounded_lists(spark):
    """A third of all posts under one name: rows list the nearest few and count them all, the long table has every one."""
    day = lambda n: dt.date(2031, 1, 1) + dt.timedelta(n)
    posts = [(n, "Common Name", f"u{n % 3}", f"p{n}", dt.datetime.combine(day(n % 40), dt.time())) for n in range(300)] + [(900 + n, "Common Name", "u9", f"q{n}", None) for n in range(5)]
    rows = [(k, "C", str(k), "Common Name", day(k), f"http://d/{k}") for k in range(12)] + [(50, "C", "50", "Common Name", None, "http://d/50")]
    frames = spark.createDataFrame(rows, TRACKER), spark.createDataFrame(posts, EXPORT), spark.createDataFrame([("http://d/0", "failed", "", "")], CACHE)
    short = {r["excel_row"]: r for r in match.reconcile(*frames, ascii_only=True, fuzzy=False, keep=6).collect()}
    whole: dict = {}
    for r in match.candidates(*frames, ascii_only=True, fuzzy=False).orderBy("excel_row", "place").collect():
        whole.setdefault(r["excel_row"], []).append((r["post_id"], r["delta"]))
    for k, _, _, _, date, _ in rows:
        want = [(p, d and date and (d.date() - date).days, n) for n, _, _, p, d in posts]
        want = sorted((x for x in want if x[1] is None or abs(x[1]) <= 7), key=lambda x: (x[1] is None, abs(x[1] or 0), x[2]))
        assert whole[k] == [x[:2] for x in want] and short[k]["n_candidates"] == len(want)
        assert [(c["post_id"], c["delta"]) for c in short[k]["candidates"]] == whole[k][:6]


def test_evidence_of_both_rosters_keeps_their_order(spark):
    """The micro list's note and row come first, lists stop at eight lines, deciding ids keep their row, either list may be missing."""
    rows = [(1, "Alpha Nova", "NO_BLOGGER", "u1"), (2, "Beta Nova", "NO_BLOGGER", "u2"), (3, "Gamma Nova", "NO_BLOGGER", "u3"), (4, "Beta Nova", "LINK_ERROR", ""), (5, "Delta Nova", "NO_BLOGGER", None), (6, None, "LINK_ERROR", "")]
    verdicts = spark.createDataFrame(rows, "excel_row int, name string, status string, author_id string")
    schema = "roster_row int, name string, namebis string, dmrid string, redbook_id string, followers int, status string"
    micro = spark.createDataFrame([(5, "first Alpha Nova", "", "d5", "U1", 9, "x"), (6, "Alpha Nova", "", "", "u1", 1, "x"), *[(n, f"Beta Nova {n}", "", "", f"b{n}", n, "x") for n in range(10, 25)], (30, "", "Gamma Nova", "", "", None, "x")], schema)
    macro = spark.createDataFrame([(7, "Beta Nova", "", "", "b7", 3, "x"), (8, "Gamma Nova!", "", "", "g8", 4, "x"), (9, "Delta Nova", None, None, None, None, "x")], schema)
    got = {r["excel_row"]: r for r in roster.evidence(roster.membership(verdicts, micro, macro), micro, macro, ascii_only=True, fuzzy=False).collect()}
    assert (got[1]["note"], got[1]["perimeter"]["method"], got[1]["perimeter"]["dmrid"], got[1]["perimeter"]["followers"]) == (None, "redbook-id", "d5", 9)
    assert (got[2]["notes"], len(got[2]["lines"]), got[2]["lines"][0], got[2]["perimeter"]["redbook_id"]) == (["several", "near-miss"], 8, "Beta Nova 10 [b10] (norm-substring)", "b7")
    assert (got[3]["note"], got[3]["perimeter"]["namebis"], got[3]["lines"]) == ("unregistered", "Gamma Nova", [])
    assert (got[4]["note"], len(got[4]["lines"]), got[4]["lines"][8], got[4]["perimeter"]) == ("dead-link", 9, "Macro: Beta Nova [b7] (norm-substring)", None)
    assert (got[5]["notes"], got[5]["perimeter"]["name"]) == (["unregistered"], "Delta Nova") and 6 not in got
    none = roster.membership(verdicts, micro.limit(0), macro)
    alone = {r["excel_row"]: r for r in roster.evidence(none, None, macro, ascii_only=True, fuzzy=False).collect()}
    assert (alone[2]["note"], alone[3]["perimeter"]["redbook_id"], set(alone)) == ("near-miss", "g8", {2, 3, 4, 5})
    assert roster.evidence(none, None, None).count() == 0


def test_sums_before_equal_a_running_sum(spark):
    import random

    from postcheck.operators import manifest, output

    draw = random.Random(4)
    rows = [(n, draw.choice([None, 1, 2, 2, 2, 2]), draw.choice([None, 0, 5, 7])) for n in range(500)]
    df = spark.createDataFrame(rows, "run_id int, at int, bytes int")
    want, so_far = {}, 0
    for n, at, size in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])):
        want[n] = so_far
        so_far += size or 0
    out = manifest.sums_before(df, ["at", "run_id"], "bytes", "before")
    assert {r["run_id"]: r["before"] for r in out.collect()} == want and out.columns == ["run_id", "at", "bytes", "before"]
    assert manifest.sums_before(df.limit(0), ["at"], "bytes", "before").count() == 0
    plan = manifest.over_budget(df.withColumn("modified_at", F.col("at")).withColumn("protected", F.lit(False)), 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 1  # that of the total
    cells = [("w", "a", c, "x", None, None) for c in (3, 20, 28, 37)] + [("w", "b", 25, "", None, None), ("w", "c", 27, None, 1.0, None), ("w", "d", 28, None, None, dt.datetime(2031, 1, 1))]
    blocks = output.free_block(spark.createDataFrame(cells, "workbook string, sheet string, col int, v_str string, v_num double, v_ts timestamp"))
    assert {r["sheet"]: r["start"] for r in blocks.collect()} == {"a": 29, "b": 20, "c": 28, "d": 20}


def _counted(plan, kind: str) -> int:
    """Rows that the nodes of a kind gave in an executed plan."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return _counted(plan.executedPlan(), kind)
    if "QueryStage" in name:
        return _counted(plan.plan(), kind)
    below = plan.children()
    own = plan.metrics().apply("numOutputRows").value() if kind in name else 0
    return own + sum(_counted(below.apply(i), kind) for i in range(below.size()))


def test_matched_rows_are_not_joined_with_candidates(spark):
    day = dt.date(2031, 1, 1)
    posts = [(n, f"Name {n}", f"u{n}", f"p{n}", dt.datetime.combine(day, dt.time())) for n in range(300)]
    rows = [(n, "C", str(n), f"Name {n}" if n % 2 else "Other", day, f"http://d/{n}") for n in range(300)] + [(400 + n, "C", "", f"Name {n}", day, None) for n in range(3)]
    cache = [(f"http://d/{n}", "ok", f"p{n}", f"u{n}") for n in range(300)]
    out = match.reconcile(spark.createDataFrame(rows, TRACKER), spark.createDataFrame(posts, EXPORT), spark.createDataFrame(cache, CACHE), ascii_only=True, fuzzy=False)
    got = {r["excel_row"]: r for r in out.collect()}
    assert len(got) == 303 and all(got[n]["status"] == "MATCH" and got[n]["name_mislabel"] == (n % 2 == 0) and got[n]["author_id"] == f"u{n}" and got[n]["candidates"] == [] for n in range(300))
    assert all(got[400 + n]["status"] == "LINK_ERROR" and got[400 + n]["candidates"][0]["post_id"] == f"p{n}" for n in range(3))
    assert _counted(out._jdf.queryExecution().executedPlan(), "Join") < 30


def test_posts_near_in_time_against_all_pairs(spark):
    """Each pair once, unknown dates near to all; the rows are repeated, not the wider posts."""
    draw = random.Random(23)
    date = lambda: None if draw.random() < 0.1 else dt.date(1969, 11, 1) + dt.timedelta(draw.randrange(150))
    need = [(n, draw.choice("ab"), date()) for n in range(60)]
    posts = [(n, draw.choice("abc"), date()) for n in range(400)]
    for some, others in ((need, posts), ([r for r in need if r[2]], [p for p in posts if p[2]])):
        for days in (0, 1, 7):
            found = match._near(spark.createDataFrame(some, "row int, k string, t_date date"), spark.createDataFrame(others, "post int, k string, x_date date"), "k", days)
            got = [(r["row"], r["post"]) for r in found.collect()]
            want = {(a, b) for a, k, t in some for b, j, x in others if k == j and (t is None or x is None or abs((x - t).days) <= days)}
            assert len(got) == len(set(got)) and set(got) == want
            assert _counted(found._jdf.queryExecution().executedPlan(), "Generate") <= 2 * len(some)
