"""Adapters and rules that a project brings."""

from skein.graph import LineageGraph
from skein.sources import packs

GOOD = """
[[adapter]]
id = "acme.route"
lang = ["python", "java"]
match = "decorator"
names = ["acme.expose", "acme.show"]
methods = ["post"]
contract = { kind = "http_route", role = "exposes", key_arg = 0, key_name = "path" }

[[rule]]
id = "waiting"
lang = "python"
severity = 3
targets = ["acme.wait"]
allowed = ["acme.sleep"]
"""
BAD = """
[[adapter]]
id = "on"
lang = "python"
match = "decorator"
names = [true]
contract = { kind = "topic", role = "exposes" }

[[adapter]]
id = "role"
lang = "python"
match = "call"
names = ["x"]
contract = { kind = "topic", role = "offers" }

[[adapter]]
id = "kept"
lang = "python"
match = "call"
names = ["bus.publish"]
contract = { kind = "topic", role = "exposes" }

[[rule]]
id = "deep"
lang = "python"
severity = 9
targets = ["x"]

[other]
a = 1
"""


def test_rows_and_refusals():
    good = packs.rows_of("g.toml", GOOD.encode())
    assert [(r["sort"], r.get("lang"), r.get("name")) for r in good if r["sort"] == "adapter"] == [("adapter", lang, n) for lang in ("python", "java") for n in ("acme.expose", "acme.show")]
    assert [(r["target"], r["allowed"], r["base"]) for r in good if r["sort"] == "rule"] == [("acme.wait", False, 3), ("acme.sleep", True, 3)]
    bad = packs.rows_of("b.toml", BAD.encode())
    assert [r["name"] for r in bad if r["sort"] == "adapter"] == ["bus.publish"]
    assert sorted((r["entry"], r["refused"]) for r in bad if r["sort"] == "refused") == [(0, "unknown table 'other'"), (1, "adapter: names must be texts"), (1, "rule: severity 9"), (2, "adapter: role 'offers'")]
    assert packs.rows_of("x.toml", b"a = ")[0]["sort"] == "refused" and packs.rows_of("y.toml", b"\xff")[0]["sort"] == "refused"
    assert packs.rows_of("z.toml", b"") == []


def test_a_project_pack_changes_contracts_risks_and_digest(spark, tmp_path):
    root, pack = tmp_path / "t", tmp_path / "pack"
    root.mkdir()
    pack.mkdir()
    (root / "a.py").write_text("@acme.expose('/x/{id}')\nasync def f(id):\n    acme.wait(1)\n")
    (pack / "g.toml").write_text(GOOD)
    plain = LineageGraph.build(spark, str(root), str(tmp_path / "g0"))
    g = LineageGraph.build(spark, str(root), str(tmp_path / "g"), pack=str(pack))
    assert plain.contract_map().count() == 0 and [(r.name, r.exposers) for r in g.contract_map().collect()] == [("POST /x/{*}", 1)]
    assert g.digest != plain.digest and g.adapter_digest != plain.adapter_digest
    assert plain.risks().total == 0 and [r.target for r in g.risks().rows.collect()] == ["acme.wait"]
    assert g.update(str(root)) is g and g.refused().count() == 0
    (pack / "g.toml").write_text(BAD)  # the tree is as it was, the pack is not
    new = g.update(str(root))
    assert new.adapter_digest != g.adapter_digest and new.contract_map().count() == 0 and new.refused().count() == 4
