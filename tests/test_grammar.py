from pyspark.sql import functions as F

from quarryline.functions import grammar


def test_type_encodings():
    assert grammar.encoded_types('@"Widget"8@0:4') == ["Widget", "id", "SEL"]
    assert grammar.encoded_types("v12@0:4i8") == ["void", "id", "SEL", "int"]
    assert grammar.encoded_types("^{CGRect={CGPoint=ff}{CGSize=ff}}[4i]b3@?r*") == ["struct CGRect *", "int[4]", "bits:3", "block", "char *"]
    assert grammar.encoded_types("{open") is None and grammar.encoded_types("") is None and grammar.encoded_types("z") is None


def test_heads_locals_and_names(spark):
    row = spark.createDataFrame([("int *do_it(const char *s, void (*f)(int, int), unsigned int n)", "{\n  int a;\n  char *p = 0;\n\n  a = 3;\n  int late;\n", "N4Base7DerivedE", "  x = y + 1;\nif (a == b) { }\n z=2;")], "h string, b string, n string, a string").select(
        grammar.heads("h").alias("h"), grammar.local_declarations("b").alias("l"), grammar.names_of("n").alias("n"), grammar.assignments(F.col("a")).alias("a"), grammar.encoding_types(F.lit("v8@0:4")).alias("e")
    ).first()
    assert row.h.name == "do_it" and row.h.result == "int *" and [(p.type, p.name) for p in row.h.parameters][::2] == [("const char *", "s"), ("unsigned int", "n")]
    assert [(x.type, x.name) for x in row.l] == [("int", "a"), ("char *", "p")] and row.n == ["Base", "Derived"] and row.e == ["void", "id", "SEL"]
    assert [(x.target, x.value) for x in row.a] == [("x", "y + 1"), ("z", "2")]
    assert grammar.prefixed_names("9ab") is None and grammar.signature("no head") is None and grammar.locals_of(None) == []
