"""Files: split JSON maps, reversible titles, ordered sinks, scratch tables."""

import json
import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citesift import session
from citesift.sources import articles as files


def _entries(n):
    return {
        str(i): {
            "url": f"u{i}",
            "publication_date": "2015",
            "publication_types": None if i % 7 == 0 else "Review;",
            "title": f'a "b" }},\n {{"x": {i}}},  \u00e9',
            "abstract": "}" * (i % 3) + " },\n" + "x" * (i % 400),
        }
        for i in range(n)
    }


@pytest.mark.parametrize("indent", [1, 4, None])
def test_one_large_object_is_read_by_several_tasks(spark, tmp_path, indent):
    entries = _entries(1500)
    text = json.dumps(entries, indent=indent)
    if indent is None:
        # An entry on each line, as some writers have it.
        text = "{\n" + ",\n".join(json.dumps(k) + ": " + json.dumps(v) for k, v in entries.items()) + "\n}\n"
    (tmp_path / "map.json").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        split = files.read_json_map(spark, str(tmp_path / "map.json"))
        assert split.rdd.getNumPartitions() > 5
        got = {r.article_key: r.asDict() for r in split.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    whole = {r.article_key: r.asDict() for r in files.read_json_map(spark, str(tmp_path / "map.json"), border=None).collect()}
    assert got == whole and set(got) == set(entries)
    assert all(got[k] == {"article_key": k, **v} for k, v in entries.items())


def test_small_and_odd_maps(spark, tmp_path):
    body = {"url": "u", "title": "t"}
    for name, text in (
        ("one", json.dumps({"1": body})),
        ("empty", "{}"),
        ("nothing", "\n"),
        ("compact", json.dumps({"1": body, "2": body})),
        ("bare", '\ufeff{\n"1": {},\n"2": {\n},\r\n"3": {}}\r\n'),
    ):
        (tmp_path / name).write_text(text, encoding="utf-8")
    read = lambda name: sorted(r.article_key for r in files.read_json_map(spark, str(tmp_path / name)).collect())
    assert (read("one"), read("empty"), read("nothing"), read("compact")) == (["1"], [], [], ["1", "2"])
    assert read("bare") == ["1", "2", "3"]


def test_a_border_inside_an_entry_fails(spark, tmp_path):
    nested = json.dumps({"1": {"url": "u", "more": {"a": 1}, "title": "t"}, "2": {"url": "v"}}, indent=1)
    (tmp_path / "nested.json").write_text(nested)
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_json_map(spark, str(tmp_path / "nested.json")).collect()
    with pytest.raises(ValueError):
        files.read_json_map(spark, str(tmp_path / "nested.json"), border=",")


def test_written_maps_come_back(spark, tmp_path):
    rows = [(i, f"u{i}", None, "k;", 'q" },\n', None if i % 2 else "a") for i in range(50)]
    table = spark.createDataFrame(rows, "article_id long, url string, publication_date date, publication_types string, title string, abstract string")
    for objects in (True, False):
        path = str(tmp_path / f"map-{objects}")
        files.write_json_map(table.repartition(3), path, objects=objects)
        back = files.read_json_map(spark, path, lines=not objects)
        assert sorted((int(r.article_key), r.url, r.title, r.abstract) for r in back.collect()) == [(i, u, t, a) for i, u, _, _, t, a in rows]
    files.write_json_map(table.limit(0), str(tmp_path / "none"), objects=True)
    assert files.read_json_map(spark, str(tmp_path / "none")).count() == 0


TITLES = [
    "a|b", "a\rb", "a\nb", "a\r\nb", '"quoted"', 'say "y"', " lead", "tail ", " ", "  ", "\t", "\ttab\t", "", None, "title", "\\", "\\\\",
    "\\|", "\\p", "\\n", "\\z", "\\0", "\\e", "\\s", "a\\", "a\\ ", "\0", "\0z", "#c", "'s [x]", "\u2028x\u0085", "\u00a0", "\x01", ",", "||",
]


def _round_trip(spark, titles, path):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, title string").coalesce(1).sortWithinPartitions("i")
    files.write_label_file(frame, path)
    return sorted([r.title for r in files.read_label_file(spark, path).collect()], key=str)


def test_every_title_survives_the_label_file(spark, tmp_path):
    assert _round_trip(spark, TITLES, str(tmp_path / "titles")) == sorted(TITLES, key=str)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.text(alphabet="\\|\n\r\0 \tpnrzse0a\"#", max_size=8), st.text(max_size=10)), max_size=30))
def test_any_title_survives_the_label_file(spark, tmp_path_factory, titles):
    titles = [t if t is None else t.encode("utf-8", "ignore").decode() for t in titles]
    assert _round_trip(spark, titles, str(tmp_path_factory.mktemp("t") / "titles")) == sorted(titles, key=str)


def test_a_label_file_from_elsewhere_is_taken_as_it_stands(spark, tmp_path):
    (tmp_path / "t.csv").write_text('title\nplain\nC:\\new "x"\n[T\'s]\n')
    got = [r.title for r in files.read_label_file(spark, str(tmp_path / "t.csv"), escaped=False).collect()]
    assert got == ["plain", 'C:\\new "x"', "[T's]"]


def _lines(folder):
    names = sorted(f for f in os.listdir(folder) if f.startswith("part-"))
    return [line for f in names for line in (folder / f).read_text().splitlines()], len(names)


def test_curves_are_one_file_each_from_left_to_right(spark, tmp_path):
    points = [(f"plot{k % 2 + 1}", f"fold{k % 3}", (k * 7919 % 1000) / 1000, k % 5 / 5) for k in range(3000)]
    files.write_curves(spark.createDataFrame(points, "plot string, fold string, x double, y double").repartition(8), str(tmp_path / "c"))
    for plot in (1, 2):
        for fold in range(3):
            lines, number = _lines(tmp_path / "c" / f"plot=plot{plot}" / f"fold=fold{fold}")
            assert number == 1 and lines[0] == "x,y"
            got = [tuple(map(float, line.split(","))) for line in lines[1:]]
            want = sorted((x, y) for p, f, x, y in points if (p, f) == (f"plot{plot}", f"fold{fold}"))
            assert got == want


def test_ranked_files_rise_in_the_order_of_their_names(spark, tmp_path):
    table = spark.range(5000).select((F.col("id") * 7919 % 5000 + 1).alias("rank"), F.lit("t").alias("title"))
    files.write_ranked(table, str(tmp_path / "r"), slices=6)
    lines, number = _lines(tmp_path / "r")
    assert number > 3 and [json.loads(x)["rank"] for x in lines] == list(range(1, 5001))


def test_scratch_tables_go_with_their_scope(spark):
    with session.scratch_scope(spark):
        kept = session.durable(spark.range(3), "gone")
        path = session._written[-1]
        assert kept.count() == 3 and session.exists(spark, path)
    assert not session.exists(spark, path) and path not in session._written
