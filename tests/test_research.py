"""The walk that researches each round's companies, with stand-in models."""

from pyspark.sql import functions as F

from kinmatch.operators.inference import infer
from kinmatch.plans.research import landscape, with_competitor_prompt


# The models are made inside functions, so that they travel to the workers by value.
def models():
    def describer():
        import json

        def answer(text):
            if text == "broken":
                raise ValueError(text)
            return {
                "target_audience": "a", "problem_solved": "p", "solution_approach": "s", "uses_ai_automation": True,
                "description_summary": text, "market_universe": "m", "universe_boundaries": "u",
            }

        return lambda texts: [json.dumps(answer(t)) for t in texts]

    def finder():
        """The first line of the prompt lists ``link:score`` pairs."""
        import json

        def answer(prompt):
            rivals = []
            for pair in filter(None, prompt.split("\n")[0].split(" ")):
                link, score = pair.split(":")
                rivals.append({"name": link, "description": "", "overlap_score": int(score), "link": link or None})
            analysis = dict(
                summary="", segments=[], market_map="", features="", differentiators=[], competitors=rivals, matrix=[],
                positioning_analysis="",
            )
            return {"search_query_used": "", "comprehensive_analysis": analysis}

        return lambda texts: [json.dumps(answer(t)) for t in texts]

    return describer, finder


def test_landscape(spark):
    describe_model, find_model = models()
    pages = spark.createDataFrame(
        [("a", "b:1 c:3 :2 a:0"), ("b", "d:2 c:1"), ("c", "broken"), ("d", "e:1"), ("x", "y:1"), ("e", "")],
        "url string, content string",
    )
    asked = lambda model, column: lambda rows: rows.withColumn("response", infer(F.col(column), model))
    walk, analyses = landscape(pages, asked(describe_model, "content"), asked(find_model, "prompt"), "a", depth=2)
    assert {(r.url, r.depth) for r in walk.visited.collect()} == {("a", 1), ("b", 2)}
    assert {(r.link, r.src) for r in walk.superset.collect()} == {("b", "a"), ("c", "a"), ("a", "a"), ("d", "b")}
    assert [sorted(r.url for r in a.collect()) for a in analyses] == [["a"], ["b"]]


def test_prompt_leaves_out_missing_features(spark):
    d = F.struct(
        *[F.lit("x").alias(n) for n in ("description_summary", "target_audience", "problem_solved", "solution_approach", "market_universe", "universe_boundaries")],
        F.lit(False).alias("uses_ai_automation"), F.col("f").alias("unique_features"),
    )
    rows = spark.createDataFrame([(["p", "q"],), ([],), (None,)], "f array<string>").withColumn("description", d)
    prompts = [r.prompt for r in with_competitor_prompt(rows).collect()]
    assert prompts[0].endswith("Uses AI or automation: No\nUnique features: p, q")
    assert all(p.endswith("automation: No") for p in prompts[1:])
