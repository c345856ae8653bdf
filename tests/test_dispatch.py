from quarryline.operators import dispatch


def test_golden_workspace(spark):
    """Six call sites: two resolved, two candidate sets, two unresolved."""
    classes = spark.createDataFrame([("arm6", "Base", "NSObject"), ("arm6", "Widget", "Base"), ("arm6", "Other", "NSObject")], "arch string, class_name string, superclass string")
    methods = [("Widget", "class", "factory"), ("Base", "instance", "cleanup"), ("Widget", "instance", "cleanup"), ("Widget", "instance", "render"), ("Other", "instance", "render"), ("Widget", "instance", "invokeSuper"), ("Widget", "instance", "invokeSelf")]
    methods = spark.createDataFrame([("arm6", c, k, s, f"{'+' if k == 'class' else '-'}[{c} {s}]", f"f{i}") for i, (c, k, s) in enumerate(methods)], "arch string, class_name string, kind string, selector string, method_id string, function_id string")
    sites = [("1010", "factory", "class_object", "Widget", None), ("1110", "cleanup", "super", None, "Widget"), ("1210", "render", None, None, None), ("1310", "setNeedsDisplay", None, None, None), ("1410", "render", "self", "Widget", "Widget"), ("1510", "externalOnly", None, None, None)]
    sites = spark.createDataFrame([("arm6", *s) for s in sites], "arch string, site string, selector string, receiver_kind string, receiver_class string, caller_class string")
    got = {r.site: r for r in dispatch.resolve(sites, classes, methods).collect()}
    assert {s: (r.classification, r.target_ids) for s, r in got.items()} == {
        "1010": ("resolved", "+[Widget factory]"), "1110": ("resolved", "-[Base cleanup]"), "1210": ("candidate_set", "-[Other render],-[Widget render]"), "1310": ("unresolved", ""),
        "1410": ("candidate_set", "-[Widget render]"), "1510": ("unresolved", ""),
    }
    assert got["1110"].path == "Base" and got["1410"].failure_reasons == "receiver_not_exact" and got["1310"].failure_reasons == "no_known_target,receiver_not_exact"
    assert dispatch.resolve(sites.where("false"), classes, methods).count() == 0
