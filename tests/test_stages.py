"""Each stage over a small workspace; what its operators promise is tested with them."""

import io
import zipfile

import pytest

from quarryline.stages import analyze, behavior, dispatch, handoff, interactions, interface, platform, recover, types
from quarryline.stages.artifact import Artifact, Workspace, run_plugins
from tests.test_images import sample


def rows(df, *columns):
    return {tuple(r) if len(columns) > 1 else r[0] for r in df.select(*columns).collect()}


@pytest.fixture(scope="module")
def make(spark):
    return lambda schema, *data: spark.createDataFrame(list(data), schema)


def test_recover(spark, make):
    method = "array<struct<selector:string,encoding:string,implementation:bigint>>"
    tables = {
        "nested_classes": make(f"arch string, class_name string, category string, instance_methods {method}, class_methods {method}", ("armv7", "Foo", None, [("tap:", "v", 0x1001), ("gone", "v", None)], [("make", "@", 0x2000)]), ("armv7", "Foo", "Extra", [("tap:", "v", 0x3000)], [])),
        "mapped": make("arch string, address long, exact_name string, function_id string", ("armv7", 0x1000, "-[Foo tap:]", "f1"), ("armv7", 0x9000, "-[Bar x]", "f2")),
        "functions": make("function_id string, external boolean, thunk boolean", ("f1", False, False), ("f2", False, False), ("f3", True, False), ("f4", False, True), ("f5", False, False)),
        "statuses": make("function_id string, status string", ("f1", "success"), ("f2", "failed")),
        "protocols": make("arch string, name string, address long, methods array<string>, inherited array<string>", ("armv7", "P", 9, ["b"], []), ("armv7", "P", 4, ["a", "b"], ["Q"])),
    }
    made = recover.recover(spark, tables)
    assert rows(made.facts["methods"], "exact_name", "function_id", "state") == {("-[Foo tap:]", "f1", "mapped"), ("+[Foo make]", None, "unmapped"), ("-[Foo(Extra) tap:]", None, "unmapped"), ("-[Bar x]", "f2", "method_only")}
    assert rows(made.facts["functions"], "function_id", "kind", "status") == {("f1", "objective_c_method", "success"), ("f2", "objective_c_method", "failed"), ("f3", "external_function", "not_eligible"), ("f4", "thunk", "not_eligible"), ("f5", "native_internal_function", None)}
    assert rows(made.facts["protocols"], "name", "address", "occurrences") == {("P", 4, 2)} and rows(made.errors, "code", "subject") == {("status_missing", "f5")}
    assert rows(made.facts["entities"], "class_name", "category", "present") == {("Foo", None, True), ("Foo", "Extra", True)}


def dispatch_tables(make):
    return {
        "functions": make("function string", ("f1",), ("f2",), ("f3",)),
        "edges": make(
            "edge string, caller string, site long, target_name string, thunk_name string", ("e1", "f1", 10, "_objc_msgSendSuper2", None), ("e2", "f1", 20, "objc_msgSend", None), ("e3", "f1", 30, None, "_objc_msgSend"),
            ("e4", "f3", 10, "objc_msgSend", None), ("e5", "f3", 40, "_printf", None), ("e6", "f3", 50, "objc_msgSend", None),
        ),
        "methods": make(
            "method_id string, function_id string, arch string, class_name string, kind string, selector string", ("m1", "f1", "arm", "Child", "instance", "tap:"), ("m2", "f2", "arm", "Base", "instance", "tap:"),
            ("m3", "f3", "arm", "Base", "class", "make"), ("m4", None, "arm", "Other", "instance", "go"), ("m5", "f5", "arm", "Child", "instance", "go"),
        ),
        "classes": make("arch string, class_name string, superclass string", ("arm", "Base", None), ("arm", "Child", "Base"), ("arm", "Other", None)),
        "references": make("caller string, address long, selector string, class_name string", ("f1", 25, "go", None), ("f3", 5, "lost", None), ("f3", 45, "go", "Other")),
        "texts": make("function string, text string", ("f1", "void f1(Child *self, SEL s) {\n Base *b;\n}"), ("f3", "void f3(void) {\n}")),
        "occurrences": make("edge string, function string, selector string, receiver string", ("e1", "f1", "tap:", "x"), ("e2", "f1", "make", "&objc::class_t::Base"), ("e3", "f1", "go", "self")),
    }


def test_dispatch(spark, make):
    made = dispatch.resolve_dispatch(spark, dispatch_tables(make))
    got = {r.edge: r for r in made.facts["callsites"].collect()}
    assert set(got) == {"e1", "e2", "e3", "e4", "e6"}
    assert (got["e1"].receiver_kind, got["e1"].target_ids, got["e1"].classification) == ("super", "m2", "resolved")
    assert (got["e2"].receiver_kind, got["e2"].class_names, got["e2"].classification) == ("class_object", ["Base"], "resolved")
    assert (got["e3"].receiver_kind, got["e3"].class_names, got["e3"].target_ids, got["e3"].classification) == ("self", ["Child"], "m5", "candidate_set")
    assert (got["e4"].selector, got["e4"].classification) == ("lost", "unresolved")
    assert (got["e6"].selector, got["e6"].class_names, got["e6"].target_ids, got["e6"].receiver_status) == ("go", ["Other"], "m4,m5", "candidate_set")
    assert rows(made.facts["classes"], "classification", "n") == {("resolved", 2), ("candidate_set", 2), ("unresolved", 1)}
    assert made.hypotheses.count() == 5 and dict(rows(made.errors, "code", "n"))["no_known_target"] == 1


def test_platform(spark, make):
    callsites = make("edge string, class_names array<string>, receiver_kind string, receiver_status string, n_targets long", ("a", ["UILabel"], "class_object", "resolved", 0), ("b", ["UILabel", "Mine"], "unknown", "candidate_set", 1), ("c", ["Mine"], "self", "resolved", 1), ("d", [], "unknown", "unresolved", 0))
    tables = {
        "imports": make("arch string, name string, ordinal int", ("arm", "_OBJC_CLASS_$_UILabel", 2), ("arm", "_memcpy", 1), ("arm", "_lost", 9)), "libraries": make("arch string, ordinal int, library string", ("arm", 1, "libSystem"), ("arm", 2, "UIKit")),
        "catalogue": make("library string, category string", ("UIKit", "ui")), "classes": make("arch string, class_name string, superclass string", ("arm", "Mine", "UILabel")), "dispatch.callsites": callsites,
    }
    made = platform.map_platform(spark, tables)
    assert rows(made.facts["symbols"], "name", "kind", "library", "category") == {("_OBJC_CLASS_$_UILabel", "objective_c_class", "UIKit", "ui"), ("_memcpy", "unknown", "libSystem", None), ("_lost", "unknown", None, None)}
    assert rows(made.facts["messages"], "edge", "status") == {("a", "external_exact"), ("b", "external_candidate"), ("c", "application_local"), ("d", "unresolved")}
    assert rows(made.errors, "code", "n") == {("ordinal_names_no_library", 1)}


XIB = b"""<document><objects><homeController id="c1" customClass="Home"><label id="l1" title="Hi" backgroundImage="pic.png"/><button id="b1"><connections><action selector="tap:" destination="c1"/></connections></button></homeController></objects></document>"""


def interface_tables(make):
    return {
        "interface_files": make("path string, content binary", ("a.xib", bytearray(XIB)), ("bad.xib", bytearray(b"<a>"))), "string_files": make("path string, content binary", ("en.lproj/x.strings", bytearray(b'"a" = "b"; "d" = "1"; "d" = "2";'))),
        "classes": make("class_name string, superclass string", ("Home", "UIViewController")), "bases": make("class_name string", ("UIViewController",)),
        "methods": make("method_id string, class_name string, selector string, function_id string", ("m1", "Home", "tap:", "f1"), ("m2", "Else", "tap:", "f2"), ("m3", "Home", "viewDidLoad", "f3")), "assets": make("asset string, asset_path string", ("p1", "img/pic@2x.png"), ("p2", "img/other.png")),
    }


def test_interface_interactions_and_handoff(spark, make):
    tables = interface_tables(make)
    ui = interface.recover_interface(spark, tables)
    assert rows(ui.facts["screens"], "node_id", "classification") == {("c1", "exact")} and rows(ui.facts["actions"], "source", "selector", "classification") == {("b1", "tap:", "exact")}
    assert rows(ui.facts["pictures"], "value", "candidate") == {("pic.png", "p1")} and rows(ui.facts["texts"], "key", "value", "locale") == {("a", "b", "en")}
    assert rows(ui.errors, "code", "subject") == {("syntax", "bad.xib"), ("duplicate_key", "en.lproj/x.strings")}
    tables |= {f"interface.{k}": v for k, v in ui.facts.items()}
    tables |= {
        "contracts": make("selector string, kind string, event string", ("viewDidLoad", "lifecycle", "view_controller")),
        "calls": make("edge string, caller string, site long, kind string, target string, classification string", ("x1", "f1", 1, "direct", "g", "exact"), ("x2", "g", 1, "direct", None, "unresolved"), ("x3", "f3", 1, "objective_c_dynamic", "g", "candidate_set")),
        "operations": make("function string, catalogued string, categories array<string>, status string, operation string, target string, classification string", ("g", "navigation", [], "unresolved", "push", "home", "exact"), ("g", None, [], "unresolved", "none", "x", "exact")),
    }
    made = interactions.recover_interactions(spark, tables)
    assert rows(made.facts["triggers"], "kind", "selector", "classification") == {("ui_action", "tap:", "exact"), ("lifecycle", "viewDidLoad", "exact")}
    assert sorted(r[0] for r in made.facts["effects"].select("classification").collect()) == ["candidate_set", "exact"] and made.hypotheses.count() == 1
    assert dict(rows(made.facts["kinds"], "kind", "n"))["navigation"] == 2 and made.errors.count() == 0
    assert rows(interactions.interaction_classes(made.facts["effects"]), "n", "classification") == {(1, "exact"), (1, "candidate_set")}
    effects = made.facts["effects"].join(made.facts["triggers"].select("trigger", "screens"), "trigger").select("effect", "kind", "classification", "screens")
    done = handoff.build_handoff(spark, {
        "effects": effects.union(make(effects.schema, ("odd", "platform_api", "unresolved", []), ("far", "state_read", "exact", ["s9"]))), "screens": ui.facts["screens"].selectExpr("concat_ws('#', path, node_id) as screen", "classification"),
        "reasons": make("subject string, reasons array<string>", ("odd", ["late", "early"])), "candidates": make("subject string, candidate string", ("odd", "b"), ("odd", "a")),
    })
    assert sorted(r.rank for r in done.facts["items"].collect()) == [1, 2, 3, 4, 5] and rows(done.errors, "subject") == {"s9"}
    assert rows(done.facts["alternatives"], "candidate_ids") == {"a,b"} and "early,late" in rows(done.facts["questions"], "reasons")
    assert {r.file.split("-")[0] for r in done.facts["packets"].collect()} == {"application", "screen"}


def test_behavior(spark, make):
    text = 'int f(int a, char *b) {\n  if (a > 3) {\n    self->count = a;\n  }\n  return 7;\n}'
    tables = {
        "texts": make("function string, text string", ("f", text), ("g", "void g(void) {\n  x = self->count + 12; y = \"34\";\n}")), "records": make("function string, type_id string, name string, position int", ("f", "t1", "b", None), ("f", "t2", "z", 0)),
        "members": make("function string, member string", ("f", "_count"), ("g", "_count")),
    }
    made = behavior.lift_behavior(spark, tables)
    assert rows(made.facts["contracts"], "function", "position", "name", "type_id") == {("f", 0, "a", "t2"), ("f", 1, "b", "t1")}
    assert rows(made.facts["returns"], "line_no", "value") == {(5, "7")} and rows(made.facts["guards"], "condition") == {"a > 3"}
    assert rows(made.facts["constants"], "function", "number") == {("f", "3"), ("f", "7"), ("g", "12")}
    assert rows(made.facts["accesses"], "function", "member", "access") == {("f", "_count", "write"), ("g", "_count", "read")}
    assert rows(made.facts["transitions"], "function", "writer") == {("g", "f")} and rows(made.facts["states"], "readers", "writers") == {("g", "f")}


def test_types(spark, make):
    tables = {
        "specs": make("node string, kind string, class_name string, protocols array<string>, exact boolean", ("f|a", "objective_c_instance", "Base", [], False), ("f|b", "objective_c_instance", "Child", [], True), ("f|c", "scalar", "int", [], True)),
        "classes": make("class_name string, superclass string", ("Base", None), ("Child", "Base")),
        "edges.assignment:2": types.assignment_edges(make("function string, target string, value string", ("f", "d", "(Base *)a"), ("f", "e", "c + 1"), ("f", "d", "e2")), make("function string, variables array<string>", ("f", list("abcde")))),
        "edges.convention:1?": make("src string, dst string", ("f|b", "f|g"), ("f|g", "f|b")),
    }
    made = types.infer_types(spark, tables)
    assert rows(made.facts["values"], "node", "n_atoms", "classification") == {("f|a", 2, "candidate_set"), ("f|b", 1, "exact"), ("f|c", 1, "exact"), ("f|d", 2, "candidate_set"), ("f|e", 1, "exact"), ("f|g", 1, "candidate_set")}
    assert rows(made.facts["cycles"], "node") == {"f|b", "f|g"}


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return bytearray(out.getvalue())


def test_analysis_workspace_and_plugins(spark, make, tmp_path):
    content, _ = sample()
    good = archive(**{"Payload/A.app/Info.plist": "x", "Payload/A.app/main": "y", "Payload/A.app/icon.png": "z", "other.txt": "q"})
    tables = {
        "archives": make("path string, content binary", ("one.zip", good), ("bad.zip", bytearray(b"no"))), "executable_names": make("archive string, path string, executable string", ("one.zip", "Payload/A.app/Info.plist", "main")),
        "executables": make("path string, content binary", ("main", bytearray(content))), **dispatch_tables(make),
    }
    place = Workspace(spark, tables, str(tmp_path))
    done = place.run([("analysis", analyze.analyze), ("dispatch", dispatch.resolve_dispatch)])
    assert rows(done["analysis"].facts["bundles"], "archive", "bundle") == {("one.zip", "Payload/A.app")}
    assert rows(done["analysis"].facts["files"], "path", "category") == {("Payload/A.app/Info.plist", "property_list"), ("Payload/A.app/main", "other"), ("Payload/A.app/icon.png", "image")}
    assert "BadZipFile" in rows(done["analysis"].errors, "code") and "-[Widget tap:]" in rows(done["analysis"].facts["methods"], "exact_name")
    assert place.tables["dispatch.callsites"].count() == 5 and dict(rows(done["dispatch"].summary(spark), "collection", "n"))["callsites"] == 5
    place.run([("dispatch", dispatch.resolve_dispatch)])  # a second run takes the first one's place

    class Count:
        def __init__(self, name):
            self.name = name

        def analyze(self, spark, tables):
            return Artifact(self.name, {"n": tables["dispatch.callsites"].groupBy().count()})

    found = run_plugins(spark, place.tables, [Count("b"), Count("a")])
    assert list(found) == ["a", "b"] and found["a"].facts["n"].first()[0] == 5
    with pytest.raises(ValueError, match="one name"):
        run_plugins(spark, {}, [Count("a"), Count("a")])


def test_native(spark, make):
    from quarryline.stages import native

    text = "*(int *)(p + 4) = 1;\n*(short *)(p + 4) = 2;\nx = *(char *)(q + 0);\n(**(code **)(*(int *)p + 8))(p);"
    tables = {
        "texts": make("function string, text string", ("f", text), ("g", "*(int *)(p + 4) = *(int *)(p + 4) + 1;")), "receivers": make("function string, base string, classes array<string>, exact boolean", ("f", "p", ["Node"], True), ("g", "p", ["Node"], True)),
        "indirect_edges": make("function string, edge string", ("f", "e1"), ("g", "e2")),
    }
    made = native.infer_native(spark, tables)
    assert {(r.owner, r.offset, tuple(r.widths), r.reasons) for r in made.facts["fields"].collect()} == {("class:Node", 4, (2, 4), "conflicting_widths,several_types"), ("anonymous:f:q", 0, (1,), "owner_not_exact")}
    assert rows(made.facts["layouts"], "owner", "n_accesses", "classification") == {("class:Node", 4, "exact"), ("anonymous:f:q", 1, "unresolved")}
    assert sorted(made.facts["accesses"].where("function = 'g'").toPandas()["access"]) == ["read", "write"]
    assert rows(made.facts["associations"], "function", "identity", "associated") == {("f", 2, True), ("g", None, False)}
