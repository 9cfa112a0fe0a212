"""Why canonical JSON is not made by the VARIANT type: where the two agree, and where VARIANT loses what equal content must keep."""

from pyspark.sql import functions as F

from statutum.functions.json_text import canonical

SAME = ['{"b":1,"a":{"d":[3,2],"c":null}}', '{"s":"\\u0105\\/\\n\\u0000\\ud83d\\ude00"}', " [1 , 2] ", '"x"', "nope"]
#: Payloads, their canonical text, and what a variant makes of them: a key that is said twice, long whole numbers, the order of keys beyond the basic plane.
APART = {
    '{"a":1,"a":2}': ('{"a":2}', None),
    '{"n":123456789012345678901234567890123456789012345678901234567890}': ('{"n":123456789012345678901234567890123456789012345678901234567890}', '{"n":1.2345678901234567E59}'),
    '{"\U0001d11e":3,"￮":4}': ('{"￮":4,"\U0001d11e":3}', '{"\U0001d11e":3,"￮":4}'),
}


def test_variant_is_not_canonical(spark):
    frame = spark.createDataFrame([(c,) for c in [*SAME, *APART]], "j string")
    got = {r.j: (r.c, r.v) for r in frame.select("j", canonical(F.col("j")).alias("c"), F.to_json(F.try_parse_json("j")).alias("v")).collect()}
    assert all(got[j][0] == got[j][1] for j in SAME) and {j: got[j] for j in APART} == APART
