"""Parts of a marker are looked up once each, and read as before."""

from weftline.operators import sidecars as B


def test_parts_that_count_as_none_and_cased_markers(spark):
    rect = '"page":"1","rect":[0,0,1,1]'
    metas = ['"rotation":false', '"rotation":null', '"rotation":"90"', '"rotation":450.9', '"rotation":"x"', '"rotation":1e12', '"status":0', '"status":"done-ish"', '"status":[]', '"field":" body "', '"field":{}']
    text = '<!-- OBJECT {"type":"A"} -->\n' + "".join(f'<!-- Region {{"field":"body",{rect},{m}}} -->\nt\n' if "field" not in m else f"<!-- rEGION {{{rect},{m}}} -->\nt\n" for m in metas)
    docs = B.parsed(spark.createDataFrame([("s", text)], "source string, text string"), {"A": {"body": "text"}})
    got = docs.first()
    assert [(r.region_no, r.error) for r in got.rejections] == [(5, "rotation isn't a number"), (6, "rotation isn't a number"), (8, "unknown status"), (11, "unknown field")]
    regions = got.objects[0].regions
    assert [r.rotation for r in regions][:4] == [0, 0, 90, 90] and {r.kind for r in regions} == {"region"} and regions[9].field == "body"
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    assert "lower(" not in plan and "is_variant_null" not in plan.lower() and "IsVariantNull" not in plan
