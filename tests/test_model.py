"""A folder of small files as a model, end to end."""

from __future__ import annotations

import hashlib

import pytest

from lamina.functions import hashing as H
from lamina.model import SpecModel, Vocabulary, find_schema_dir, read_config, settings
from lamina.sources import xml as X

WORDS = Vocabulary(spec="urn:s", index="urn:i", relation="urn:r", mapping="urn:m")
HEAD = '<s:spec xmlns:s="urn:s" xmlns:i="urn:i" xmlns:p="urn:layers:prose" xmlns:r="urn:r" xmlns:m="urn:m">'
CODE = "one\ntwo\n\nfour\nfive\n"


def sha(text):
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def model(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("spec")
    section = X.digest(X.parse(HEAD + '<p:note id="n1">First note.</p:note></s:spec>').children[0].children[0])
    mapping = lambda i, node, h, lines, rh: f'<m:mapping id="{i}"><m:spec-ref node="{node}" node-hash="{h}"/><m:artifact path="code.py"><m:range hash="{rh}" start-line="{lines[0]}" end-line="{lines[1]}"/></m:artifact></m:mapping>'
    (folder / "sub").mkdir()
    (folder / "index.xml").write_text(HEAD + '<i:file href="sub/a.xml"/><i:file href="gone.xml"/></s:spec>')
    (folder / "sub" / "a.xml").write_text(
        HEAD + '<p:note id="n1">First note.</p:note><p:note id="n2">Second <b>note</b>.</p:note><r:relation type="refines" from="n1" to="n2"/><r:relation type="depends-on" from="n2" to="n1"/><r:relation type="references" from="n1" to="lost"/>'
        + mapping("m1", "n1", section, (1, 2), sha("one\ntwo")) + mapping("m2", "n2", "sha256:0", (1, 1), sha("one")) + mapping("m3", "n1", section, (4, 4), sha("other")) + "</s:spec>"
    )
    (folder / "broken.xml").write_text("<a>")
    return SpecModel(spark, str(folder), WORDS)


@pytest.fixture
def code(spark):
    return spark.createDataFrame([("code.py", CODE)], "path string, content string")


def test_files_and_validation(model):
    assert [r["path"] for r in model.spec_files().orderBy("ord").collect()] == ["sub/a.xml", "index.xml"]
    assert {(r["rule"], r["detail"]) for r in model.validate().where("rule <> 'well-formed'").collect()} == {("reference", "lost")}
    assert [r["path"] for r in model.validate().where("rule = 'well-formed'").collect()] == ["broken.xml"]


def test_queries(model):
    assert [r["value"] for r in model.query("//p:note[2]", namespaces={"p": "urn:layers:prose"}).collect()] == ["Second note."]


def test_drift_and_coverage(model, code):
    assert {r["id"]: r["status"] for r in model.drift(code).collect()} == {"m1": "clean", "m2": "spec-drifted", "m3": "artifact-drifted"}
    assert {r["id"]: r["status"] for r in model.drift(code.limit(0)).collect()} == {"m1": "unavailable", "m2": "spec-drifted", "m3": "unavailable"}
    files, runs = model.coverage(code)
    assert [tuple(r) for r in files.collect()] == [("code.py", 4, 3, 75.0)]
    assert [tuple(r) for r in runs.collect()] == [("code.py", 5, 5)]
    assert model.node_coverage().first().asDict() == {"total": 5, "mapped": 2, "exempt": 0, "unmapped": 3}
    shown = {r["id"]: r["fragment"] for r in model.report(code).collect()}
    assert shown["m1"] == "    1 | one\n    2 | two" and shown["m3"] == "    4 | four"


def test_connectivity_and_chunks(model):
    found = model.connectivity()
    assert found["cycles"].first()["members"] == ["n1", "n2"] and found["cycles"].first()["violation"]
    assert [r["missing"] for r in found["dangling"].collect()] == ["lost"]
    chunk = {r["id"]: r for r in model.chunks().collect()}
    assert (chunk["n2"]["layer"], chunk["n2"]["outgoing"], chunk["n2"]["incoming"]) == ("prose", ["depends-on"], ["refines"])
    assert chunk["n2"]["text"] == "[layer=prose path=spec>note]\nSecond note."


def test_settings_and_schema_folder(spark, tmp_path):
    (tmp_path / "schemas").mkdir()
    (tmp_path / "a" / "b").mkdir(parents=True)
    assert find_schema_dir(tmp_path / "a" / "b") == tmp_path / "schemas"
    (tmp_path / "c.json").write_text('[{"name": "x", "runs": 2},\n {"name": "y", "runs": 3}]')
    assert sorted((r["name"], r["runs"]) for r in read_config(spark, str(tmp_path / "c.json")).collect()) == [("x", 2), ("y", 3)]
    (tmp_path / "s.json").write_text('{"k": 1}')
    assert settings(tmp_path / "s.json", {"k": 0, "l": 5}) == {"k": 1, "l": 5} and settings(tmp_path / "no.json", {"l": 5}) == {"l": 5}
    assert H.PREFIX == "sha256:"
