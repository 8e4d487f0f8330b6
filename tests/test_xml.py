import gzip
from collections import Counter
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

import queries
from cratework.operators.quality import LoadRejected
from cratework.sources import xml_dumps


def write(folder, name, text):
    path = folder / name
    if name.endswith(".gz"):
        path.write_bytes(gzip.compress(text.encode("utf-8")))
    else:
        path.write_text(text, encoding="utf-8")
    return str(path)


def records(spark, folder, kind, body, name=None, **options):
    path = write(folder, name or f"x_20250601_{kind}.xml", f"<{kind}>\n{body}\n</{kind}>\n")
    return xml_dumps.read_records(spark, path, kind, **options)


def good(df):
    return {r["id"]: r for r in xml_dumps.accepted(df).drop("position").collect()}


ARTISTS = """
<artist><images><image type="primary"/></images><id>1</id><name> Röyksopp 🎵 </name>
  <realname></realname><profile>A &amp; B</profile><data_quality>Correct</data_quality>
  <urls><url>http://a</url><url> </url></urls><namevariations><name>RX</name></namevariations>
  <aliases><name id="5">Five</name><name>No id</name><name id="6"> </name></aliases></artist>
<artist><name>No id</name></artist>
<artist><id>x</id><name>Bad id</name></artist>
<artist><id>0</id><name>Zero</name></artist>
<artist><id>2</id></artist>
<artist><id>3</id><name>Bad alias</name><aliases><name id="x">A</name></aliases></artist>
<artist><id>4</id><name>Broken &undeclared; </name></artist>
<artist><id>5</id><name>Unclosed<b></name></artist>
<artist><id>9</id><name>Last</name></artist>
"""


def test_artists(spark, tmp_path):
    df = records(spark, tmp_path, "artists", ARTISTS)
    rows = good(df)
    assert sorted(rows) == [1, 9]
    first = rows[1]
    assert first["name"] == "Röyksopp 🎵"
    assert first["real_name"] is None and first["profile"] == "A & B"
    assert first["urls"] == ["http://a"] and first["name_variations"] == ["RX"]
    assert [tuple(a) for a in first["aliases"]] == [(5, "Five"), (None, "No id")]
    assert rows[9]["urls"] is None and rows[9]["aliases"] is None
    assert df.where("not valid").count() == 7


LABELS = """
<label><id>1</id><name>Parent</name><contactinfo>mail</contactinfo><parentLabel id="77">P</parentLabel>
  <sublabels><label id="456">A</label><label id="bad">B</label><label>C</label></sublabels></label>
<label><id>2</id><name>Child</name><parentLabel id="bad">Q</parentLabel></label>
<label><id>3</id></label>
"""


def test_labels_keep_nested_labels(spark, tmp_path):
    rows = good(records(spark, tmp_path, "labels", LABELS))
    assert sorted(rows) == [1, 2]
    assert rows[1]["subsidiaries"] == [456] and rows[1]["parent_label_id"] == 77
    assert rows[1]["contact_info"] == "mail"
    assert rows[2]["parent_label_id"] is None and rows[2]["subsidiaries"] is None


def test_labels_without_an_attribute_end_a_record_early(spark, tmp_path):
    nested = LABELS.replace("<label>C</label>", '<label id="9">C</label>')
    df = records(spark, tmp_path, "labels", nested)
    assert good(df)[1]["subsidiaries"] == [456, 9] and df.where("not valid").count() == 1


def test_a_broken_label_spoils_only_itself(spark, tmp_path):
    def label(i):
        return f"<label><id>{i}</id><name>L{i}</name></label>\n"

    body = "".join(map(label, range(1, 41))) + "<label><id>41</id><name>broken</label>\n"
    body += "<label><id>42</id><name>never closed</name>\n"
    body += "".join(map(label, range(100, 1100)))
    df = records(spark, tmp_path, "labels", body)
    assert len(good(df)) == 1040 and df.where("not valid").count() == 2
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = records(spark, tmp_path, "labels", body)
        assert df.rdd.getNumPartitions() > 1 and len(good(df)) == 1040
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


MASTERS = """
<master id="10"><main_release>100</main_release><artists><artist><id>1</id></artist></artists>
  <genres><genre>Rock</genre></genres><styles><style>Pop</style><style/></styles>
  <year>1985</year><title>Ten</title><notes>n</notes></master>
<master id="11"><main_release>bad</main_release><year>bad</year><title>Eleven</title></master>
<master><title>No id</title></master>
<master id="x"><title>Bad id</title></master>
<master id="12"></master>
<master/><master id="13"/>
<master id="0"><title>Zero is an id here</title></master>
<master id="14" />
"""


def test_masters(spark, tmp_path):
    df = records(spark, tmp_path, "masters", MASTERS)
    rows = good(df)
    assert sorted(rows) == [0, 10, 11] and df.where("not valid").count() == 6
    assert (rows[10]["main_release_id"], rows[10]["year"]) == (100, 1985)
    assert rows[10]["genres"] == ["Rock"] and rows[10]["styles"] == ["Pop"]
    assert (rows[11]["main_release_id"], rows[11]["year"]) == (None, None)


RELEASES = """
<release id="1" status="Accepted"><artists><artist><id>7</id><name>Seven</name><anv>VII</anv>
  <join>&amp;</join><role></role><tracks></tracks></artist>
  <artist><id>bad</id><name>Dropped</name></artist><artist><name>No id</name></artist><artist/></artists>
  <title>One</title><labels><label name="L" catno="C-1" id="5"/><label name="M" id="bad"/><label/></labels>
  <extraartists><artist><id>8</id><name>Eight</name><role>Producer</role><tracks>1 to 3</tracks></artist></extraartists>
  <formats><format name="Vinyl" qty="2" text="Red"><descriptions><description>LP</description>
    <description>Album</description></descriptions></format><format name="CD"><description>Mini</description></format></formats>
  <genres><genre>Rock</genre></genres><country>UK</country><released>1999-03-00</released>
  <notes>Some notes</notes><data_quality>Correct</data_quality><master_id is_main_release="true">10</master_id>
  <tracklist><track><position>A1</position><title>T</title><duration>3:45</duration></track>
    <track type="heading"><title>H</title></track><track></track></tracklist></release>
<release id="2" status="Draft"><title>Two</title><released>1999-03</released><master_id>11</master_id></release>
<release id="3"><title></title></release>
<release><title>No id</title></release>
<release id="4"><title>Four</title><released>2023/12/25</released><year>1984</year></release>
"""


def test_releases(spark, tmp_path):
    df = records(spark, tmp_path, "releases", RELEASES)
    rows = good(df)
    assert sorted(rows) == [1, 2, 4] and df.where("not valid").count() == 2
    one = rows[1]
    assert [tuple(a) for a in one["artists"]] == [
        (7, "Seven", "VII", "&", None, None), (None, "No id", None, None, None, None)
    ]
    assert [tuple(a) for a in one["extraartists"]] == [
        (8, "Eight", None, None, "Producer", "1 to 3")
    ]
    assert [tuple(x) for x in one["labels"]] == [(5, "L", "C-1"), (None, "M", None)]
    assert [tuple(f) for f in one["formats"]] == [
        ("Vinyl", "2", "Red", ["LP", "Album"]), ("CD", None, None, ["Mini"])
    ]
    assert [tuple(t) for t in one["tracklist"]] == [
        ("A1", "T", "3:45", None), (None, "H", None, "heading")
    ]
    assert (one["master_id"], one["country"], one["released"]) == (10, "UK", None)
    assert str(rows[2]["released"]) == "1999-03-01" and rows[2]["status"] == "Draft"
    assert rows[2]["artists"] is None and rows[2]["formats"] is None
    assert rows[4]["released"] is None and rows[4]["year"] == 1984


def test_gzip_equals_plain(spark, tmp_path):
    plain = good(records(spark, tmp_path, "releases", RELEASES))
    packed = records(spark, tmp_path, "releases", RELEASES, name="x_20250601_releases.xml.gz")
    assert packed.rdd.getNumPartitions() > 1
    assert plain == good(packed)


def test_long_text(spark, tmp_path):
    text = "long text " * 10000
    body = f'<release id="1"><title>T</title><notes>{text}</notes></release>'
    assert good(records(spark, tmp_path, "releases", body))[1]["notes"] == text.strip()


def test_many_splits_read_every_record_once(spark, tmp_path):
    body = "\n".join(
        f'<release id="{i}" status="Accepted">\n<title>Release {i}</title>\n</release>'
        for i in range(20000)
    )
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        df = records(spark, tmp_path, "releases", body)
        assert df.rdd.getNumPartitions() > 4
        row = df.agg(F.count("*"), F.countDistinct("id"), F.count_if("valid")).first()
        assert tuple(row) == (20000, 20000, 20000)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def roots_of(spark, path, kind):
    roots = Observation()
    xml_dumps.read_records(spark, path, kind, roots).write.format("noop").mode(
        "overwrite"
    ).save()
    return roots.get["opened"], roots.get["closed"]


def test_truncated_and_empty_files_are_noticed(spark, tmp_path):
    whole = "<releases>\n<release id='1'><title>A</title></release>\n"
    assert roots_of(spark, write(tmp_path, "a.xml", whole + "</releases>"), "releases") == (1, 1)
    cut = write(tmp_path, "b.xml", whole + "<release id='2'><title>B</title>")
    assert roots_of(spark, cut, "releases") == (1, 0)
    assert roots_of(spark, write(tmp_path, "c.xml", ""), "releases") == (0, 0)
    xml_dumps.check_roots(1, 1)
    for opened, closed in ((1, 0), (0, 0)):
        with pytest.raises(LoadRejected):
            xml_dumps.check_roots(opened, closed)


def test_corrupt_gzip_fails(spark, tmp_path):
    path = tmp_path / "x_20250601_releases.xml.gz"
    path.write_bytes(b"not gzip at all")
    with pytest.raises(Exception):
        xml_dumps.read_records(spark, str(path), "releases").collect()


def test_newest_dump(spark, tmp_path):
    for name in ("x_20250501_artists.xml.gz", "x_20250601_artists.xml.gz",
                 "x_20250701_labels.xml.gz"):
        write(tmp_path, name, "<artists></artists>")
    files = xml_dumps.dump_files(spark, str(tmp_path), "artists")
    assert files.count() == 2
    assert xml_dumps.newest_dump(files).first()["file_name"] == "x_20250601_artists.xml.gz"


def test_a_dump_may_be_a_folder_of_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "DUMP_FILE", 30)
    monkeypatch.setattr(queries, "shared_folder", lambda _: str(tmp_path))
    rows = spark.range(100).selectExpr("id AS s_suppkey", "'L' AS s_name")
    catalogue = SimpleNamespace(spark=spark, table=lambda _: rows)
    top = queries._dump_folder(catalogue, ["labels"])
    newest = xml_dumps.newest_dump(xml_dumps.dump_files(spark, top, "labels")).first()
    assert newest["file_name"] == "x_20250601_labels.xml"
    assert len([p for p in Path(top, newest["file_name"]).iterdir() if p.name.startswith("part-")]) > 1
    read = xml_dumps.read_dump(spark, newest["path"], "labels")
    assert sorted(r.id for r in read.collect()) == list(range(1, 100))


def test_dumps_of_queries_have_a_row_per_record(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "DUMP_FILE", 30, raising=False)
    catalogue = SimpleNamespace(spark=spark)
    records = spark.range(100).selectExpr("id", "concat('<label><id>', id, '</id></label>') AS value")
    lines = spark.read.text(queries._dump(catalogue, "labels", records, "id"))
    found = Counter(r.value for r in lines.collect())
    assert found.pop("<labels>") == found.pop("</labels>") == 4
    assert found == Counter(f"<label><id>{i}</id></label>" for i in range(100))
