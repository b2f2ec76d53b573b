"""Java and TypeScript read from tokens: brackets, symbols, references, and what a build makes of them."""

import pytest

from skein.graph import LineageGraph
from skein.sources import brace, tokens

TREE = {
    "src/main/java/com/x/Order.java": '''package com.x;

import com.y.Repo;
import static com.y.Util.help;

@Entity("orders")
public class Order<T extends Base> extends Base<T> implements Payable, Named {
    private static final int LIMIT = 3;
    private final Repo repo = new Repo();
    List<String> names;

    public Order(Repo repo, int size) {
        this.repo = repo;
        super.init(size);
    }

    @Override
    public String pay(final String who, Map<String, Integer> extra) throws IOException {
        // a comment { with brace
        String done = repo.save(who, size("}"), LIMIT);
        if (done == null) { throw new IllegalStateException("none"); }
        for (Item it : items) { it.run(); }
        Runnable r = () -> help(done);
        return done;
    }

    public String pay(int who) { return pay("x", null); }

    enum Kind { A, B(2), C { }; int n; Kind() {} }
    interface Inner { void go(); }
}
''',
    "src/main/java/com/x/Base.java": "package com.x;\npublic class Base { void init(int a) { } }\n",
    "src/main/java/com/x/Payable.java": "package com.x;\npublic interface Payable { String pay(String a, Map<String, Integer> b); }\n",
    "src/main/java/com/y/Repo.java": "package com.y;\npublic class Repo { public String save(String a, int b, int c) { return a; } }\n",
    "src/main/java/com/y/Util.java": "package com.y;\npublic class Util { public static void help(String s) {} }\n",
    "src/main/java/com/z/Bad.java": "class Bad { void x( { }\n",
    "web/app.ts": '''import { Store, load as fetchAll } from './lib/store';
import * as util from "./lib/util";
import React from 'react';

export interface Shape { area(): number; name: string }
export type Id = string;

@Component({selector: 'x'})
export class View extends Base implements Shape {
  private store: Store;
  name = 'a';
  constructor(private readonly http: Http, count?: number) { super(); this.store = new Store(count); }
  async area(): Promise<number> {
    const n = this.store.size(1);
    const text = `hi ${n}`;
    return util.pad(n) / 2;
  }
}

export const twice = (x: number) => { return fetchAll(x, x); };
export async function main(a: View, b = 3) {
  let v = new View(null, b);
  const r = /[}/]+/g;
  v.area();
  a.area();
  twice(b);
}
''',
    "web/lib/store.ts": "export class Store {\n  size(n: number) { return n }\n}\nexport function load(a: number, b: number) { return a; }\n",
    "web/lib/util.ts": "export function pad(n: number): number { return n; }\nexport class Base { close() {} }\n",
    "svc.py": "def go(t):\n    save(t)\n",
}


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("brace")
    for path, text in TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return LineageGraph.build(spark, str(root), str(tmp_path_factory.mktemp("g") / "graph"))


def test_tokens_and_brackets():
    source = "a(b[1], 'x)') // )\nc = /[)\"]/g; d = `}`; /* { */ é{}"
    rows, wrong = tokens.rows_of("f.ts", "typescript", source.encode())
    assert wrong is None
    assert [r["text"] for r in rows] == ["a", "(", "b", "[", "1", "]", ",", "'x)'", ")", "c", "=", "/[)\"]/g", ";", "d", "=", "`}`", ";", "é", "{", "}"]
    raw = source.encode()
    assert all(raw[r["a"] : r["b"]].decode() == r["text"] for r in rows)
    assert rows[1]["pair"] == 8 and [x["text"] for x in rows[1]["args"]] == ["b[1]", "'x)'"] and rows[3]["around"] == [1] and rows[4]["up"] == 3
    assert (rows[0]["line"], rows[9]["line"]) == (1, 2)
    for bad in ("f(", "f)", "{(})"):
        assert tokens.rows_of("f.ts", "typescript", bad.encode())[1]
    assert tokens.rows_of("f.java", "java", b"") == ([], None)
    assert len(tokens.rows_of("f.java", "java", b"{" * 500 + b"}" * 500)[0]) == 1000


def symbols(graph):
    return {(r["dotted"], r.kind, r["flags"] & ~256): r for r in graph.nodes.where("kind <> 'module'").collect()}


def test_java_symbols(graph):
    got = set(symbols(graph))
    assert {
        ("com.x.Order", "class", 0), ("com.x.Order.LIMIT", "constant", 10), ("com.x.Order.repo", "field", 8), ("com.x.Order.names", "field", 0), ("com.x.Order.Order", "constructor", 0), ("com.x.Order.pay", "method", 0),
        ("com.x.Order.pay.who", "parameter", 0), ("com.x.Order.pay.done", "variable", 0), ("com.x.Order.Kind", "enum", 0), ("com.x.Order.Kind.A", "enum_member", 0), ("com.x.Order.Kind.B", "enum_member", 0), ("com.x.Order.Kind.C", "enum_member", 0),
        ("com.x.Order.Kind.Kind", "constructor", 0), ("com.x.Order.Inner", "interface", 0), ("com.x.Order.Inner.go", "method", 0), ("com.y.Util.help", "method", 2),
    } <= got
    pays = graph.nodes.where("dotted = 'com.x.Order.pay'").collect()
    assert {r.signature for r in pays} == {"(who: String, extra: Map)", "(who: int)"} and len({r.id for r in pays}) == 2
    assert {(r["start_line"], r["end_line"]) for r in pays} == {(17, 25), (27, 27)}


def test_typescript_symbols(graph):
    got = set(symbols(graph))
    assert {
        ("web.app.Shape", "interface", 16), ("web.app.Shape.area", "method", 0), ("web.app.Shape.name", "field", 0), ("web.app.Id", "type_alias", 16), ("web.app.View", "class", 16), ("web.app.View.store", "field", 0),
        ("web.app.View.constructor", "constructor", 0), ("web.app.View.constructor.http", "parameter", 0), ("web.app.View.area", "method", 1), ("web.app.twice", "function", 16), ("web.app.main", "function", 17), ("web.app.main.v", "variable", 0),
    } <= got
    assert {r.name for r in graph.nodes.where("kind = 'variable' and file_path = 'web/app.ts'").collect()} == {"n", "text", "v", "r"}


def test_resolved_edges(graph):
    n = {r.id: r for r in graph.nodes.collect()}
    got = {(n[r.src]["dotted"], r.kind, n[r.dst]["dotted"]) for r in graph.edges.collect()}
    assert {
        ("com.x.Order", "INHERITS", "com.x.Base"), ("com.x.Order", "IMPLEMENTS", "com.x.Payable"), ("com.x.Order.pay", "CALLS", "com.y.Repo.save"), ("com.x.Order.pay", "CALLS", "com.y.Util.help"),
        ("com.x.Order", "HAS_TYPE", "com.y.Repo"), ("com.x.Order.pay", "READS", "com.x.Order.LIMIT"), ("com.x.Order.Order", "WRITES", "com.x.Order.repo"), ("com.x.Order.pay", "WRITES", "com.x.Order.pay.done"),
        ("com.x.Order.pay.who", "PARAM_BINDS", "com.y.Repo.save.a"), ("com.y.Repo.save", "RETURNS", "com.x.Order.pay.done"),
        ("web.app.View", "INHERITS", "web.lib.util.Base"), ("web.app.View", "IMPLEMENTS", "web.app.Shape"), ("web.app.View.area", "CALLS", "web.lib.store.Store.size"), ("web.app.View.area", "CALLS", "web.lib.util.pad"),
        ("web.app.twice", "CALLS", "web.lib.store.load"), ("web.app.main", "INSTANTIATES", "web.app.View"), ("web.app.main", "CALLS", "web.app.View.area"), ("web.app.main", "CALLS", "web.app.twice"), ("web.app", "IMPORTS", "web.lib.store.Store"), ("web.app.twice.x", "PARAM_BINDS", "web.lib.store.load.a"),
    } <= got
    # names of one language never mean symbols of another
    assert all(n[r.src].lang == n[r.dst].lang or n[r.dst].kind == "contract" for r in graph.edges.collect())


def test_files_that_do_not_parse_are_boundaries(graph):
    assert {(r.file_path, r.kind) for r in graph.boundaries.where("kind = 'parse_error'").collect()} == {("src/main/java/com/z/Bad.java", "parse_error")}
    assert graph.files.where("path = 'src/main/java/com/z/Bad.java'").first().parse_status == "error"


def test_questions_on_java(graph):
    assert {r.name for r in graph.callers_of("com.y.Repo.save").rows.collect()} == {"pay"}
    assert "Order" in {r.name for r in graph.impact_of("com.x.Base").rows.collect()}


def test_module_paths(spark):
    rows = spark.createDataFrame([("src/main/java/a/B.java",), ("svc/src/test/java/a/B.java",), ("src/x/index.ts",), ("types.d.ts",), ("index.js",)], "p string").select(brace.module("p")).collect()
    assert [r[0] for r in rows] == ["a/B", "a/B", "x", "types", "index"]
