import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ripplegraph.functions import text
from ripplegraph.model import Options, parse_mappings
from ripplegraph.operators import resources
from ripplegraph.operators.reports import workbook
from ripplegraph.sources import batch, config, mapper


def test_properties():
    lines = "# note\n! note\na=1\nb : two words\nc three\nlong = x\\\n   y\nk\\=e\\:y = \\u0041\\t\nempty\n"
    assert {k: v for _, k, v in config.properties(lines)} == {"a": "1", "b": "two words", "c": "three", "long": "xy", "k=e:y": "A\t", "empty": ""}


def test_yaml():
    lines = "a:\n  b: 1 # note\n  c:\n    d: 'x'\n  e: \"y\"\n# note\nf: http://z\n- item\n"
    assert {k: v for _, k, v in config.yaml(lines)} == {"a.b": "1", "a.c.d": "x", "a.e": "y", "f": "http://z"}


def test_yaml_keeps_keys_as_written():
    lines = "a:\n  - b: c\n  \"k\": v\n: none\nplain\n  # x: y\n"
    assert {k: v for _, k, v in config.yaml(lines)} == {"a.- b": "c", 'a."k"': "v"}


def test_tables_of_finished_work_go(spark, tmp_path):
    from pathlib import Path

    from ripplegraph.storage import materialize, scratch, shared_folder, write_file

    before = materialize(spark.range(3).toDF("id"), "kept")
    with scratch(spark):
        inner = materialize(before, "gone")
        path = Path(inner.inputFiles()[0].removeprefix("file:")).parent
        assert path.exists() and inner.count() == 3
    assert not path.exists() and before.count() == 3 and str(shared_folder(spark)).startswith("file:")
    write_file(spark, f"{tmp_path}/a/b.txt", "é")
    assert (tmp_path / "a" / "b.txt").read_text() == "é"


def expand(value, configs, visiting=frozenset()):
    """Placeholders one by one, by recursion."""

    def one(m):
        key = m[1].strip()
        if key in visiting:
            return m[0]
        return expand(configs[key], configs, visiting | {key}) if key in configs else m[2] or m[0]

    return re.sub(config.PLACEHOLDER, one, value) if configs else value


def resolved(spark, configs, values):
    """Values of project p as resolve() gives them, with clashing names beside them."""
    known = spark.createDataFrame([("p", k, v) for k, v in configs.items()] + [("q", "only", "q")], "project string, key string, value string")
    rows = spark.createDataFrame([("p", i, v) for i, v in enumerate(values)], "project string, key int, raw string")
    found = config.resolve(rows, known, "raw", "value").collect()
    assert len(found) == len(values)
    return [r["value"] for r in sorted(found, key=lambda r: r["key"])]


def test_placeholders(spark):
    c = {"a": "${b}", "b": "x${c:1}", "loop": "${loop2}", "loop2": "<${loop}${b}>", "self": "s${self}${a}", "in": "${loop}/${self:d}/${ loop2\t}", "e": ""}
    values = ["${a}/${none}/${none:d}", "${loop}", "${loop2}${loop}", "${self}", "${in}-${in}", "no", "", None, "${", "${}", "${:x}", "a${e}b${e:z}", "${none:}", "${a}" * 50, "$1\\${b}"]
    assert resolved(spark, c, values) == [v if v is None else expand(v, c) for v in values]
    other = spark.createDataFrame([("none", "${a:d}"), (None, "${a}")], "project string, raw string")
    known = spark.createDataFrame([("p", "a", "1")], "project string, key string, value string")
    assert {r["out"] for r in config.resolve(other, known, "raw", "out").collect()} == {"${a:d}", "${a}"}  # without any configuration nothing is touched


def test_nesting_of_fifty_takes_a_few_rounds(spark):
    c = {f"k{i}": f"{i % 10}${{k{i + 1}:end}}" for i in range(50)}
    rounds = []
    real = config._fill
    config._fill = lambda *x: rounds.append(1) or real(*x)
    try:
        assert resolved(spark, c, ["${k0}", "${k49}"]) == [expand("${k0}", c), "9end"]
    finally:
        config._fill = real
    assert len(rounds) <= 8


@settings(max_examples=4, deadline=None)
@given(st.dictionaries(st.sampled_from("abcde"), st.text("ab${}:", max_size=12) | st.sampled_from(["${a}${b}", "${c:x}", "-${d}${e}", "${b}"]), max_size=5))
def test_placeholders_of_any_form(spark, c):
    values = ["${a}|${b}|${c}", "${d:${a}}${e}", *c.values()]
    assert resolved(spark, c, values) == [expand(v, c) for v in values]


def test_config_from_files(spark, tmp_path):
    (tmp_path / "a.properties").write_text("k=1\nx=p")
    (tmp_path / "b.yml").write_text("k: 2")
    (tmp_path / "c.yaml").write_text("k: 3")
    got = {r["key"]: r["value"] for r in config.key_values(config.read_files(spark, str(tmp_path), "p")).collect()}
    assert got == {"k": "3", "x": "p"}


MAPPER = """<mapper namespace='n.M'><sql id='a'>ta <include refid='b'/></sql><sql id='b'>join tb on <include refid='a'/></sql>
<select id='s'>select * from <include refid='a'/> x <if test='q'>where <include refid='b'/></if></select><delete id='d'>delete from td</delete></mapper>"""


def test_mapper(spark, tmp_path):
    (tmp_path / "m.xml").write_text(MAPPER)
    (tmp_path / "other.xml").write_text("<beans/>")
    (tmp_path / "bad.xml").write_text("<mapper namespace='x'>")
    got = {r["id"]: (r["kind"], " ".join(r["sql"].split())) for r in mapper.statements(mapper.read_files(spark, str(tmp_path), "p")).collect()}
    assert got["d"] == ("delete", "delete from td")
    assert got["s"][1] == "select * from ta join tb on x where"  # cycles end; includes inside other tags stay out


@pytest.mark.parametrize(
    "sql,want",
    [
        ("select a.x from t1 a join s.t2 b on a.i=b.i left join (select * from t3) c on 1=1", ["t1", "s.t2", "t3"]),
        ("select * from t1, t2 as b, t3 where x in (select y from t4)", ["t1", "t2", "t3", "t4"]),
        ("update t1 set a = 1 where b = 'from t9'", ["t1"]),
        ("insert into t1 (a) select a from t2", ["t1", "t2"]),
        ("delete from `t1` where a = NULL", ["t1"]),
        ("with q as (select * from t1) select * from q join t2 on q.a = t2.a", ["t1", "t2"]),
        ("select extract(year from d) from t1 -- from t2", ["t1"]),
        ("select trim(both 'x' from c) from t", ["t"]),
        ("select substring(a from 2 for 3), extract(day from d) from t, u", ["t", "u"]),
        ("select trim(both (select x from s) from c) from t", ["s", "t"]),
        ("merge into t using s on (t.id = s.id) when matched then update set a = 1 when not matched then insert (a) values (s.a)", ["t", "s"]),
        ("merge t using (select * from s) q on t.id = q.id when matched then delete", ["t", "s"]),
        ("delete from a using b, c where a.id = b.id", ["a", "b", "c"]),
        ("delete a from t1 a join t2 b on a.id = b.id", ["t1", "t2"]),
        ("select * from f(1), t", ["t"]),
        ("select * from generate_series(1, 3) as g(n) join t on t.n = g.n", ["t"]),
        ("select * from lateral (select * from t) x, t2", ["t", "t2"]),
        ("select * from t, lateral (select * from u where u.i = t.i) x left join v on true", ["t", "u", "v"]),
        ("create table x as select * from y", ["x", "y"]),
        ("create table if not exists x (a int, b text)", ["x"]),
        ("create or replace view v as with q as (select * from t) select * from q", ["v", "t"]),
        ("truncate table t", ["t"]),
        ("select * from (t1 join t2 on t1.a = t2.a), t3", ["t1", "t2", "t3"]),
        ("select * from (t1, t2) left join t3 on true", ["t1", "t2", "t3"]),
        ("select * from a.b.c x join `d`.`e` y using (id)", ["a.b.c", "d.e"]),
        ("select * from t1 where a is distinct from b and c is not distinct from d", ["t1"]),
        ("select * from (with q as (select * from t) select * from q) x, q", ["t", "q"]),
        ("with q as (select * from t), r (a, b) as (select * from q) select * from r join q on true", ["t"]),
        ("with recursive q as (select 1 union all select a from q join t on true) select * from q", ["t"]),
        ("with q as (select * from s) insert into t select * from q", ["s", "t"]),
        ("with q as (select * from s) delete from t using q where t.i = q.i", ["s", "t"]),
        ("insert ignore into t (a, b) values (1, 2) on duplicate key update a = values(a)", ["t"]),
        ("replace into t select * from u", ["t", "u"]),
        ("update t1 a join t2 b on a.i = b.i set a.x = b.x", ["t1", "t2"]),
        ("update t1, t2 set t1.x = t2.x where t1.i in (select i from t3)", ["t1", "t2", "t3"]),
        ("update t set x = s.x from s, u where t.i = s.i", ["t", "s", "u"]),
        ("select (select max(a) from t1), (select min(b) from t2) from t3 for update", ["t1", "t2", "t3"]),
        ("select * from t1 force index (i) where exists (select 1 from t2 where t2.a = t1.a)", ["t1", "t2"]),
        ("(select a from t1) union (select b from t2) except select c from t3 order by 1", ["t1", "t2", "t3"]),
        ("select * from unnest(array[1]) u, t", ["t"]),
        ("select * from t1 natural left join t2 cross join t3 as c", ["t1", "t2", "t3"]),
        ("select case when a from t", ["t"]),
        ("call proc()", None),
        ("select 1 )", None),
        ("select (", None),
    ],
)
def test_tables(sql, want):
    assert mapper.tables(sql) == want


def test_options():
    o = Options.of({"max_depth": 500, "row_timeout_seconds": -1, "excluded_prefixes": "java., \nx.", "service_mappings": "a=b\n# c=d\nbad\na=e"})
    assert (o.max_depth, o.row_timeout_seconds, o.excluded_prefixes, o.service_mappings) == (100, 0, ("java.", "x."), {"a": "e"})
    assert [Options.of({"row_timeout_seconds": n}).row_timeout_seconds for n in (0, 300, -1, 100000)] == [0, 300, 0, 86400]
    assert parse_mappings("") == {}


def test_settings_of_many_projects(spark):
    from ripplegraph.model import changed, effective
    from ripplegraph.sources import settings

    shared = {"max_depth": "7", "excluded_prefixes": "a., b.\nc.", "query_patterns": "x,y\nz", "service_mappings": "a=b\n# c=d\n e = f=g\na=h\n=i\nj=\nk"}
    own = [{"use_shared": "true", "max_depth": "500"}, {"max_depth": "500", "row_timeout_seconds": "-3"}, {"use_shared": "no", "excluded_prefixes": "", "merge_resources": "true", "service_mappings": ""}, {"depth_first": "false", "max_depth": None, "query_patterns": "a,b"}]
    rows = [(f"p{i}", k, v) for i, o in enumerate([shared, *own]) for k, v in o.items()]
    rows = [("*" if p == "p0" else p, k, v) for p, k, v in rows] + [(None, "max_depth", "1"), ("p9", None, "1")]
    got = {r["project"]: r for r in settings.options(spark.createDataFrame(rows, "project string, name string, value string")).collect()}
    assert set(got) == {f"p{i}" for i in range(1, 5)}
    for i, o in enumerate(own, 1):
        given = {k: v for k, v in effective(o | {"use_shared": o.get("use_shared") == "true"}, shared).items() if v is not None and k != "use_shared"}
        want = Options.of({k: v == "true" if k in ("merge_resources", "depth_first") else v for k, v in given.items()})
        assert {f: (tuple(v) if isinstance(v, list) else v) for f, v in got[f"p{i}"].asDict().items() if f != "project"} == vars(want)
    a, b = {"a": "x, y,x", "n": "1", "s": "v"}, {"a": "x\ny", "n": "2", "t": "w"}
    row = spark.createDataFrame([(a, b)], "a map<string,string>, b map<string,string>")
    assert set(row.select(settings.changed(F.col("a"), F.col("b"))).first()[0]) == changed(a, b) == {"n", "s", "t"}


def test_lines_of_many_texts(spark):
    texts = spark.createDataFrame([(1, " /a \r\n\n/b"), (2, "/a\r/a"), (3, ""), (4, None)], "line int, raw string")
    got = batch.validate(batch.split_lines(texts), ("line", "line_no")).orderBy("line", "line_no").collect()
    assert [(r["line"], r["line_no"], r["value"], r["duplicate"]) for r in got] == [(1, 1, "/a", False), (1, 3, "/b", False), (2, 1, "/a", True), (2, 2, "/a", True)]


def test_batch_inputs(spark):
    raw = "\n".join([" /a ", "", "b", "/a", "/c d", "/e?x", "/"] + [f"/p{i}" for i in range(100)])
    good, errors, note = batch.accepted(batch.validate(batch.lines(spark, raw)))
    assert good[0] == "/a" and len(good) == 101
    assert errors[0].startswith("第 3 行 `b`") and len(errors) == 5 and "当前为 101 个" in errors[-1]
    assert "第 4 行重复：`/a`" in note
    assert batch.accepted(batch.validate(batch.lines(spark, " \n"))) == ([], ["请输入至少一个 HTTP 接口路径。"], "")


def test_merging(spark):
    rows = [(1, "MYSQL", "t", "READ", 0, "x", None), (2, "MYSQL", "t", "READ", 2, "y", "p"), (3, "MYSQL", "t", "READ", 2, "y", "q"), (4, "REDIS", "k", "READ", 1, "z", None)]
    r = spark.createDataFrame(rows, "ord int, type string, name string, operation string, conf_rank int, detail string, source string")
    assert resources.distinct_evidence(r).count() == 3
    got = {x["name"]: x for x in resources.merge(resources.distinct_evidence(r)).collect()}
    assert got["t"]["conf_rank"] == 2 and got["t"]["detail"] == "x\n---\ny" and got["t"]["source"] == "p"
    assert resources.merge(resources.merge(r)).count() == 2


def test_paths(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("/api/", "order/", "/"), (None, " ", None), ("a", "/b//c/", "d")], "a string, b string, c string")
    got = [tuple(r) for r in rows.select(text.normalize_path(F.col("a"), F.col("b")), text.normalize_path(F.col("a"), F.col("c")), text.normalize_path(F.col("a"), F.col("c"), fixed=True)).collect()]
    assert got == [("/api/order", "/api/", "/api"), ("/", "/", "/"), ("/a/b/c", "/a/d", "/a/d")]


def test_topics(spark):
    from pyspark.sql import functions as F

    topics = ["${a.t}", "${b.t}", "x.t", "t:tag", "t", "${a.t}:tag"]
    got = dict(spark.createDataFrame([(t,) for t in topics], "t string").select("t", text.match_key(F.col("t"))).collect())
    assert len({got["x.t"], got["t:tag"], got["t"]}) == 1 and got["${a.t}"] == got["${a.t}:tag"] != got["${b.t}"]


def test_letters_and_workbook():
    assert [text.column_letters(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert workbook({"a&b": [["x<y", "1"]]})[:2] == b"PK"
