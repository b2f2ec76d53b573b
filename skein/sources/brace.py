"""Symbols and references of brace languages, read from token rows with windows and joins.

Tokens of one bracket are siblings, and a bracket pair stands among them as two of them: a declaration is a pattern over a few
siblings.  Statements are siblings between ``;`` and ``}``.  Declarations own brackets (bodies, parameter lists); the brackets around
a token, matched with those owners, give its container and its member path in one join, however deep.  Symbols of equal spans
are merged later by id.

What is read: types with bases, methods, constructors, functions (arrows that a name is given too), parameters, fields, enum members,
local values; calls with receiver and arguments, instantiations, decorators, imports, throws, named types, reads and writes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.traverse import settle
from . import tokens as T

#: Fixed values of the languages.
TYPE_WORDS = {"class": "class", "interface": "interface", "enum": "enum", "record": "struct"}
MODIFIERS = ("public", "private", "protected", "static", "final", "abstract", "async", "export", "default", "readonly", "override", "declare", "synchronized", "native", "transient", "volatile", "strictfp", "sealed", "get", "set")
KEYWORDS = ("if", "for", "while", "switch", "catch", "return", "super", "this", "new", "function", "try", "throw", "assert", "do", "else", "typeof", "await", "synchronized", "import", "package", "case", "instanceof", "in", "of", "extends", "implements", "void", "null", "true", "false", "undefined", "const", "let", "var", "class", "interface", "enum", "yield", "delete", "break", "continue", "default", "finally", "throws", "as", "from", "type", *MODIFIERS)
PRIMITIVES = ("int", "long", "short", "byte", "char", "float", "double", "boolean", "void", "var", "string", "number", "any", "unknown", "never", "object", "bigint", "symbol")
FLAG_WORDS = {"async": 1, "static": 2, "abstract": 4, "final": 8, "export": 16}
_ASSIGN = ("=", "+=", "-=", "*=", "/=", "%=", "|=", "&=", "^=")
#: Folders above the packages of a source tree.
ROOTS = r"^(?:.*/)?src/(?:main|test)/(?:java|kotlin|scala)/|^src/"
HELD, LOOK = ["file_path", "lang", "service_id"], 5


def module(path: Column | str) -> Column:
    """A file's path below its source root, without its extension; an index file stands for its folder."""
    plain = F.regexp_replace(F.regexp_replace(path, ROOTS, ""), r"(?:\.d)?\.[^./]+$", "")
    return F.regexp_replace(plain, r"(?<=[^/])/index$", "")


def _words(c: Column, values) -> Column:
    return F.coalesce(c.isin(*values), F.lit(False))


def siblings(t: DataFrame) -> DataFrame:
    """Tokens with their neighbours ``p1..``, ``n1..`` (empty where there is none), their statement, and what stands in it."""
    s = W.partitionBy("file_path", "up").orderBy("i")
    text = lambda k: F.coalesce((F.lead if k > 0 else F.lag)("text", abs(k)).over(s), F.lit(""))
    kind = lambda k: F.coalesce((F.lead if k > 0 else F.lag)("kind", abs(k)).over(s), F.lit(""))
    near = {f"p{k}": text(-k) for k in range(1, LOOK)} | {f"n{k}": text(k) for k in range(1, LOOK + 1)} | {"pk1": kind(-1), "pk2": kind(-2), "nk1": kind(1), "nk2": kind(2)}
    near |= {f"i{k}": F.lead("i", k).over(s) for k in range(1, 4)} | {"args1": F.lead("args", 1).over(s), "b2": F.lead("b", 2).over(s), "line0": F.lag("end_line", 1).over(s), "brace3": F.lag("i", 3).over(s)}
    before = s.rowsBetween(W.unboundedPreceding, -1)
    angle = F.when(F.col("text") == "<", 1).when(F.col("text") == ">", -1).otherwise(0)
    near |= {"stmt": F.coalesce(F.sum(F.col("text").isin(";", "}").cast("int")).over(before), F.lit(0)), "angle": F.sum(angle).over(s.rowsBetween(W.unboundedPreceding, 0))}
    t = t.withColumns(near)
    t = t.withColumn("comma", F.coalesce(F.sum(((F.col("text") == ",") & (F.col("angle") == 0)).cast("int")).over(before), F.lit(0)))
    w = W.partitionBy("file_path", "up", "stmt").orderBy("i")
    past, after, whole = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(0, W.unboundedFollowing), w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    flag = reduce(lambda x, y: x.bitwiseOR(y), [F.coalesce(F.max(F.when(F.col("text") == word, bit)).over(past), F.lit(0)) for word, bit in FLAG_WORDS.items()])
    typed = F.when((F.col("kind") == "word") & ~_words(F.col("text"), MODIFIERS) & (F.col("p1") != "@"), F.col("text"))
    section = F.when(F.col("text").isin("extends", "implements"), F.col("text"))
    return t.withColumns({
        "assigned": F.coalesce(F.max((F.col("text") == "=").cast("int")).over(past), F.lit(0)) == 1, "flags": flag, "first_type": F.first(typed, True).over(whole), "from_a": F.first("a").over(whole), "from_line": F.first("line").over(whole),
        "brace": F.min(F.when(F.col("text") == "{", F.col("i"))).over(after), "end_b": F.coalesce(F.min(F.when(F.col("text") == "}", F.col("b"))).over(after), F.max("b").over(whole)),
        "to_line": F.coalesce(F.min(F.when(F.col("text") == "}", F.col("end_line"))).over(after), F.max("end_line").over(whole)), "stmt_b": F.max("b").over(whole),
        "section": F.last(section, True).over(past), "section_i": F.last(F.when(section.isNotNull(), F.col("i")), True).over(past), "head": F.last(F.when((F.col("kind") == "word") & F.col("text").isin(*TYPE_WORDS), F.col("i")), True).over(past),
    })


def classified(t: DataFrame) -> DataFrame:
    """Tokens with ``sort``: what a word declares or refers to, if anything."""
    c = F.col
    word, java = c("kind") == "word", c("lang") == "java"
    name = word & ~_words(c("text"), KEYWORDS)
    plain_type = _words(c("text"), TYPE_WORDS) & (c("nk1") == "word") & ~_words(c("n1"), ("extends", "implements")) & ~_words(c("p1"), (".", "?.", "=", ":", ",")) & ((c("text") != "record") | (java & c("n2").isin("(", "<")))
    alias = ~java & (c("text") == "type") & (c("nk1") == "word") & c("n2").isin("=", "<")
    t = t.withColumn("type_kind", F.when(word & plain_type, F.when((c("text") == "interface") & (c("p1") == "@"), "annotation").otherwise(F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPE_WORDS.items() for x in kv]), c("text")))).when(word & alias, "type_alias"))
    bodies = t.where("type_kind is not null and type_kind <> 'type_alias' and brace is not null").select("file_path", c("brace").alias("up"), c("n1").alias("owner_name"), c("type_kind").alias("owner_kind"))
    t = t.join(bodies.dropDuplicates(["file_path", "up"]), ["file_path", "up"], "left")
    inside = c("owner_kind").isNotNull()
    enum = c("owner_kind") == "enum"
    fresh = (c("p1") == "") | c("p1").isin(";", "}") | _words(c("p1"), MODIFIERS) | (c("line0") < c("line")) | (c("p1") == ")")
    called = name & (c("n1") == "(") & ~_words(c("p1"), (".", "?.", "new", "@", "::", "function"))
    member = F.coalesce(enum, F.lit(False)) & (c("stmt") == 0) & name & c("p1").isin("", ",") & (c("n1").isin("", ",", ";", "(", "{", "="))
    method = called & inside & ~c("assigned") & (c("n3").isin("{", ";", "throws", ":", "default", "") | (~java & (c("n3") != "."))) & (java | fresh | (c("p1") == "*"))
    function = word & (c("n1").isin("(", "<")) & ((c("p1") == "function") | ((c("p1") == "*") & (c("p2") == "function")))
    arrow = ~java & name & c("p1").isin("const", "let", "var") & (c("n1") == "=") & (((c("n2") == "(") & c("n4").isin("=>", ":")) | ((c("n2") == "async") & (c("n3") == "(") & c("n5").isin("=>", ":")))
    typed_before = ((c("pk1") == "word") & ~_words(c("p1"), set(KEYWORDS) - {"void"})) | c("p1").isin(">", "]")
    field = name & inside & ~c("assigned") & ((java & typed_before & c("n1").isin("=", ";", ",")) | (~java & fresh & c("n1").isin(":", "=", ";", "?", "!", "")))
    local_java = java & name & ~inside & ((typed_before & c("n1").isin("=", ";", ":")) | ((c("p1") == "var") & c("n1").isin("=", ":"))) & (c("up") >= 0)
    local = local_java | (~java & name & ~inside & c("p1").isin("const", "let", "var"))
    declared = F.when(member, "enum_member").when(method | function | arrow, "callable").when(field, "field").when(local, "local")
    made = name & (c("p1") == "new") & c("n1").isin("(", "<")
    call = name & (((c("n1") == "(") & ~_words(c("p1"), ("new", "function", "@"))) | (c("p1") == "::"))
    based = name & c("section").isNotNull() & (c("section_i") > c("head")) & ((c("brace") > c("i")) | c("brace").isNull()) & ~c("p1").isin(".", "<") & (c("angle") == 0) & (c("p1").isin("extends", "implements", ","))
    own = c("p1").isin(".", "?.") & (c("p2") == "this")
    stored = name & _words(c("n1"), _ASSIGN) & (~c("p1").isin(".", "?.") | own)
    # a word between signs, that nothing is done with but to read it
    read = name & ~_words(c("text"), PRIMITIVES) & ~_words(c("n1"), ("(", ":", "=>", "->", *_ASSIGN)) & (c("nk1") != "word") & (own | (~c("p1").isin(".", "?.", "@", "new", "::", "<") & ((c("pk1") != "word") | c("p1").isin("return", "throw", "await", "case", "in", "of"))))
    use = F.when(name & (c("p1") == "@"), "decorate").when(made, "instantiate").when(call & (declared.isNull() | ~declared.isin("callable", "enum_member")), "call").when(based & declared.isNull(), "base").when(stored & (declared.isNull() | declared.isin("local", "field")), "write").when(read & declared.isNull() & ~inside, "read")
    first = F.when((c("n1") == "=") & (c("n2") == "new"), c("n3"))
    type_ref = F.when(java, F.when((c("p1") == "var"), first).otherwise(F.when(c("pk1") == "word", c("p1")).otherwise(c("first_type")))).otherwise(F.when(c("n1") == ":", c("n2")).when((c("n1").isin("?", "!")) & (c("n2") == ":"), c("n3")).otherwise(first))
    opened = F.when(arrow, F.when(c("n2") == "(", c("i2")).otherwise(c("i3"))).otherwise(F.when(c("n1") == "(", c("i1")))
    return t.withColumns({"sort": declared, "use": use, "value_type": type_ref, "params": opened, "own": own})


def _id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 32)


def extract(ledger: DataFrame) -> DataFrame:
    """Rows of ``code.RAW`` of the brace languages' files; a file whose brackets do not match gives one boundary row."""
    files = ledger.where(F.col("lang").isin(*T.BRACES) & F.col("content").isNotNull())
    raw = settle(T.tokens(files))
    whose = files.select(F.col("path").alias("file_path"), "lang", "service_id", module(F.col("path")).alias("module"))
    broken = raw.where("kind = 'error'").select(F.lit("boundary").alias("rec"), "file_path", F.lit("parse_error").alias("kind"), F.col("text").alias("name"), F.col("line").alias("start_line"))
    t = settle(classified(siblings(raw.where("kind <> 'error'").join(whose, "file_path"))))
    c = F.col
    modules = whose.join(raw.where("kind <> 'error'").groupBy("file_path").agg(F.max("end_line").alias("end_line"), F.max("b").alias("end_byte")), "file_path", "left").join(broken.select("file_path"), "file_path", "left_anti")
    modules = modules.withColumn("module_id", _id(c("service_id"), c("lang"), c("module"), F.lit("module"), c("file_path")))

    # declarations that own brackets, and the parameters in theirs
    types = t.where("type_kind is not null").select(*HELD, c("i1").alias("nid"), c("n1").alias("name"), c("type_kind").alias("kind"), "up", c("brace").alias("body"), F.lit(None).cast("int").alias("params"), "flags", "from_a", "end_b", "from_line", "to_line", "stmt", F.lit(None).cast("string").alias("value_type"))
    kind = F.when(c("owner_kind").isNull(), "function").when((c("text") == c("owner_name")) | (c("text") == "constructor"), "constructor").otherwise("method")
    returned = F.when((c("lang") == "java") & (c("pk1") == "word") & ~_words(c("p1"), KEYWORDS) & ~_words(c("p1"), PRIMITIVES), c("p1"))
    calls = t.where("sort = 'callable'").select(*HELD, c("i").alias("nid"), c("text").alias("name"), kind.alias("kind"), "up", F.when(c("brace") > c("i"), c("brace")).alias("body"), "params", "flags", "from_a", "end_b", "from_line", "to_line", "stmt", returned.alias("value_type"))
    decl = settle(types.union(calls))
    lists = decl.where("params is not null").select("file_path", c("nid").alias("of"), c("params").alias("up"))
    p = t.join(lists, ["file_path", "up"]).where((c("kind") == "word") & (c("angle") == 0) & ~_words(c("text"), MODIFIERS) & (c("p1") != "@"))
    seg = W.partitionBy("file_path", "up", "comma").orderBy("i")
    whole = seg.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    java = c("lang") == "java"
    p = p.withColumns({"first": F.first("text").over(whole), "nth": F.row_number().over(seg), "last": F.row_number().over(seg.orderBy(F.desc("i")))})
    p = p.where(F.when(java, c("last") == 1).otherwise((c("nth") == 1)))
    p_type = F.when(java, F.when(c("first") != c("text"), c("first"))).otherwise(F.when(c("n1") == ":", c("n2")).when((c("n1") == "?") & (c("n2") == ":"), c("n3")))
    params = settle(p.select(*HELD, "of", c("i").alias("nid"), c("text").alias("name"), "up", "a", "b", "line", c("comma").cast("int").alias("position"), p_type.alias("value_type")))
    sign = params.groupBy("file_path", "of").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", F.concat_ws(": ", "name", "value_type").alias("s")))), lambda x: x["s"]), ", ").alias("s"))
    decl = decl.join(sign.withColumnRenamed("of", "nid"), ["file_path", "nid"], "left").withColumn("signature", F.when(c("kind").isin("function", "method", "constructor"), F.concat(F.lit("("), F.coalesce("s", F.lit("")), F.lit(")"))).otherwise("")).drop("s")

    # around every bracket: the owners of the brackets around it, outermost first
    owners = decl.select("file_path", "nid", "name", "signature", "kind", F.explode(F.array_compact(F.array("body", "params"))).alias("open"))
    brackets = raw.where("around is not null").select("file_path", c("i").alias("bracket"), F.explode(F.concat("around", F.array("i"))).alias("open"))
    around = brackets.join(owners, ["file_path", "open"]).groupBy("file_path", "bracket").agg(F.array_sort(F.collect_list(F.struct("open", "nid", "name", F.concat("name", "signature").alias("label"), "kind"))).alias("path"))
    around = settle(around.withColumnRenamed("bracket", "up"))

    def placed(df: DataFrame) -> DataFrame:
        """With member names, labels and the container of each row."""
        none = F.array().cast("array<string>")
        df = df.join(around, ["file_path", "up"], "left").join(modules.select("file_path", "module", "module_id"), "file_path")
        get = lambda f: F.coalesce(F.transform("path", lambda x: x[f]), none)
        last = F.try_element_at("path", F.lit(-1))
        return df.withColumns({"members": get("name"), "labels": get("label"), "in_kind": last["kind"]})

    def node_id(labels: Column) -> Column:
        return _id(c("service_id"), c("lang"), c("module"), F.array_join(labels, "\0"))

    def container(df: DataFrame) -> DataFrame:
        df = placed(df)
        return df.withColumn("holder", F.when(F.size("labels") > 0, node_id(c("labels"))).otherwise(c("module_id")))

    def symbol(df: DataFrame) -> DataFrame:
        df = container(df).withColumn("own", F.concat("labels", F.array(F.concat("name", "signature"))))
        names = F.concat("members", F.array("name"))
        java = c("lang") == "java"
        package = F.when(c("module").contains("/"), F.regexp_replace("module", "/[^/]*$", ""))
        top = F.when(java, package).otherwise(c("module"))
        dotted = F.concat_ws(".", F.replace(top, F.lit("/"), F.lit(".")), F.array_join(names, "."))
        return df.select(
            F.lit("node").alias("rec"), "file_path", node_id(c("own")).alias("id"), "kind", "name", F.concat(c("service_id"), F.lit("/"), c("lang"), F.lit("/"), c("module"), F.lit("#"), F.array_join(names, "/")).alias("qualified_name"),
            dotted.alias("dotted"), "signature", "flags", c("holder").alias("parent_id"), c("from_line").alias("start_line"), c("to_line").alias("end_line"), c("from_a").alias("start_byte"), c("end_b").alias("end_byte"), "lang", c("value_type").alias("type_ref"), "position",
        )

    values = t.where("sort in ('field', 'local', 'enum_member')")
    upper = c("text").rlike("^[A-Z][A-Z0-9_]*$")
    constant = F.when(java, c("flags").bitwiseAND(F.lit(10)) == 10).otherwise(upper & (c("p1") == "const"))
    value_kind = F.when(c("sort") == "enum_member", "enum_member").when(constant, "constant").when(c("sort") == "field", "field").otherwise("variable")
    blank = F.lit("").alias("signature")
    values = values.select(*HELD, "up", c("text").alias("name"), value_kind.alias("kind"), blank, "flags", c("a").alias("from_a"), c("b").alias("end_b"), c("line").alias("from_line"), c("end_line").alias("to_line"), F.when(~_words(c("value_type"), PRIMITIVES), c("value_type")).alias("value_type"), F.lit(None).cast("int").alias("position"))
    asks = params.select(*HELD, "up", "name", F.lit("parameter").alias("kind"), blank, F.lit(0).alias("flags"), c("a").alias("from_a"), c("b").alias("end_b"), c("line").alias("from_line"), c("line").alias("to_line"), F.when(~_words(c("value_type"), PRIMITIVES), c("value_type")).alias("value_type"), "position")
    whole_decl = decl.select(*HELD, "up", "name", "kind", "signature", "flags", "from_a", "end_b", "from_line", "to_line", F.lit(None).cast("string").alias("value_type"), F.lit(None).cast("int").alias("position"))
    nodes = symbol(whole_decl.unionByName(values).unionByName(asks))
    tops = modules.select(F.lit("node").alias("rec"), "file_path", c("module_id").alias("id"), F.lit("module").alias("kind"), F.substring_index("module", "/", -1).alias("name"), F.concat_ws("/", "service_id", "lang", "module").alias("qualified_name"), F.when(c("lang") != "java", F.replace("module", F.lit("/"), F.lit("."))).alias("dotted"), F.lit("").alias("signature"), F.lit(0).alias("flags"), F.lit(1).alias("start_line"), F.coalesce("end_line", F.lit(1)).alias("end_line"), F.lit(0).alias("start_byte"), F.coalesce("end_byte", F.lit(0)).alias("end_byte"), "lang")

    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [tops, nodes, broken, references(t, decl, params, modules, container, node_id)])


def references(t: DataFrame, decl: DataFrame, params: DataFrame, modules: DataFrame, container, node_id) -> DataFrame:
    """Reference rows: from the innermost declaration around each, decorators and bases from what they stand at."""
    c = F.col
    chain = F.when(c("p1").isin(".", "?.", "::"), F.when(c("pk2") == "word", F.when(c("p3").isin(".", "?.") & c("p4").rlike(r"^[\w$]+$"), F.concat_ws(".", "p4", "p2")).otherwise(c("p2"))).otherwise(F.lit("()")))
    said = lambda r: F.concat_ws(".", r, "text")
    cols = [*HELD, "up", "i", "stmt", c("text").alias("name"), "a", "b", "line", "end_line"]
    no_args = F.array().cast("array<struct<index:int,name:string,text:string>>")
    given = F.when(c("n1") == "(", F.coalesce("args1", no_args)).otherwise(no_args)
    receiver = F.when(c("own"), F.lit("this")).otherwise(F.when(c("use") == "call", chain))
    kind = F.when(c("use") == "base", F.when(c("section") == "extends", "inherit").otherwise("implement")).otherwise(c("use"))
    upto = F.when(c("use").isin("call", "instantiate", "decorate") & (c("n1") == "("), c("b2")).when(c("use") == "write", c("stmt_b")).otherwise(c("b"))
    uses = t.where("use is not null").select(*cols, kind.alias("kind"), receiver.alias("receiver"), said(receiver).alias("ref_text"), given.alias("args"), upto.alias("to_b"), "head", "use")
    thrown = t.where("use = 'instantiate' and p2 = 'throw'").select(*cols, F.lit("throw").alias("kind"), F.lit(None).cast("string").alias("receiver"), c("text").alias("ref_text"), no_args.alias("args"), c("b").alias("to_b"), "head", "use")
    at_decl = decl.select("file_path", "up", "stmt", c("nid").alias("d_nid"), c("name").alias("d_name"), c("signature").alias("d_sign"))
    first = at_decl.groupBy("file_path", "up", "stmt").agg(F.min(F.struct("d_nid", "d_name", "d_sign")).alias("d"))
    uses = container(uses.unionByName(thrown)).join(first, ["file_path", "up", "stmt"], "left")
    outward = c("d").isNotNull() & (((c("use") == "decorate") & (c("i") < c("d.d_nid"))) | ((c("use") == "base") & (c("i") > c("d.d_nid"))))
    uses = uses.withColumn("from_node", F.when(outward, node_id(F.concat("labels", F.array(F.concat("d.d_name", "d.d_sign"))))).otherwise(c("holder")))
    # a base in a list that no type stands before is none; nor is a read or write outside of a callable, or in a list of parameters
    lists = decl.where("params is not null").select("file_path", c("params").alias("up"), F.lit(True).alias("listed"))
    uses = uses.join(lists, ["file_path", "up"], "left").where(c("listed").isNull() | ~c("use").isin("read", "write"))
    uses = uses.where((c("use") != "base") | outward).where(~c("use").isin("read", "write") | c("in_kind").isin("function", "method", "constructor"))
    out = [uses.select(*HELD, "kind", "name", "ref_text", "receiver", "from_node", c("line").alias("start_line"), c("end_line"), c("a").alias("start_byte"), c("to_b").alias("end_byte"), "args")]

    typed = t.where("sort in ('field', 'local') and value_type is not null").select(*cols, c("value_type").alias("said"))
    typed = typed.unionByName(params.where("value_type is not null").select(*HELD, "up", c("nid").alias("i"), F.lit(0).cast("long").alias("stmt"), "name", "a", "b", "line", c("line").alias("end_line"), c("value_type").alias("said")))
    typed = typed.unionByName(decl.where("value_type is not null").select(*HELD, "up", c("nid").alias("i"), "stmt", "name", c("from_a").alias("a"), c("end_b").alias("b"), c("from_line").alias("line"), c("to_line").alias("end_line"), c("value_type").alias("said")))
    typed = container(typed.where(~_words(c("said"), PRIMITIVES) & c("said").rlike(r"^[\w$]+$")))
    out.append(typed.select(*HELD, F.lit("type").alias("kind"), c("said").alias("name"), c("said").alias("ref_text"), F.lit(None).cast("string").alias("receiver"), c("holder").alias("from_node"), c("line").alias("start_line"), "end_line", c("a").alias("start_byte"), c("b").alias("end_byte"), no_args.alias("args")))
    refs = reduce(DataFrame.unionByName, out)

    imports = settle(_imports(t))
    seen = imports.groupBy("file_path", "alias").agg(F.min("target").alias("full"))
    head = F.substring_index("ref_text", ".", 1)
    refs = refs.withColumn("alias", head).join(seen, ["file_path", "alias"], "left")
    refs = refs.withColumn("target", F.when(c("full").isNotNull(), F.concat(c("full"), F.expr("substring(ref_text, length(alias) + 1)")))).drop("full", "alias")
    brought = imports.join(modules.select("file_path", "lang", "module_id"), "file_path").select("file_path", "lang", F.lit("import").alias("kind"), F.substring_index("target", ".", -1).alias("name"), c("target").alias("ref_text"), "target", c("module_id").alias("from_node"), c("line").alias("start_line"), c("line").alias("end_line"), c("a").alias("start_byte"), c("b").alias("end_byte"), no_args.alias("args"))
    return refs.drop("service_id").unionByName(brought, allowMissingColumns=True).withColumn("rec", F.lit("ref"))


def _imports(t: DataFrame) -> DataFrame:
    """``(file_path, alias, target, a, b, line)``: what a file brings in, by the name it has there; relative modules are made absolute."""
    c = F.col
    words = t.where("lang = 'java' and up = -1").withColumn("lead", F.first("text").over(W.partitionBy("file_path", "up", "stmt").orderBy("i")))
    words = words.where("lead = 'import'").groupBy("file_path", "stmt").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.when(~c("text").isin("import", "static", ";"), c("text")).alias("x")))), lambda x: x["x"]), "").alias("target"), F.min("a").alias("a"), F.max("b").alias("b"), F.min("line").alias("line"))
    java = words.where("not endswith(target, '*')").select("file_path", F.substring_index("target", ".", -1).alias("alias"), "target", "a", "b", "line")
    # the string after from, and the names before it
    said = t.where("lang <> 'java' and kind = 'string' and p1 in ('from', 'import')").withColumn("source", F.expr("substring(text, 2, length(text) - 2)"))
    folder = F.when(c("module").contains("/"), F.regexp_replace("module", "/[^/]*$", "")).otherwise("")
    ups = F.regexp_count("source", F.lit(r"\.\./"))
    base = F.slice(F.filter(F.split(folder, "/"), lambda x: x != ""), F.lit(1), F.greatest(F.size(F.filter(F.split(folder, "/"), lambda x: x != "")) - ups, F.lit(0)))
    rest = F.regexp_replace(F.regexp_replace("source", r"^(?:\.{1,2}/)+", ""), r"\.[jt]sx?$|/index$", "")
    full = F.when(c("source").startswith("."), F.array_join(F.concat(base, F.array(rest)), "/")).otherwise(c("source"))
    said = said.withColumn("full", F.replace(full, F.lit("/"), F.lit(".")))
    whole = said.where("p1 = 'from' and pk2 = 'word'").select("file_path", c("p2").alias("alias"), F.when(c("p3") == "as", c("full")).otherwise(F.concat("full", F.lit("."), "p2")).alias("target"), "a", "b", "line")
    bare = said.where("p1 = 'import'").select("file_path", F.lit(None).cast("string").alias("alias"), c("full").alias("target"), "a", "b", "line")
    open_ = said.where("p1 = 'from' and p2 = '}'").select("file_path", c("brace3").alias("up"), "full")
    names = t.where("kind = 'word' and p1 <> 'as' and text <> 'as' and not (text = 'type' and nk1 = 'word' and n1 <> 'as')").join(open_, ["file_path", "up"])
    names = names.select("file_path", F.when(c("n1") == "as", c("n2")).otherwise(c("text")).alias("alias"), F.concat("full", F.lit("."), "text").alias("target"), "a", "b", "line")
    return java.union(whole).union(bare).union(names)
