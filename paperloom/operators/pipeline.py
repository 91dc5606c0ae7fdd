"""The whole chain over all documents: answers and tokens in, validated fields, summaries and actions out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialized as keep
from ..settings import DEFAULT, Settings
from ..sources.providers import ModelProvider, OcrProvider
from . import classify, extract, insights, layout, sections, validate, vision


@dataclass
class Result:
    blocks: DataFrame
    classifications: DataFrame
    sections: DataFrame
    fields: DataFrame
    issues: DataFrame
    status: DataFrame
    summaries: DataFrame
    actions: DataFrame


def process(pages: DataFrame, ocr: OcrProvider, model: ModelProvider, old_actions: DataFrame | None = None, s: Settings = DEFAULT) -> Result:
    """Gates stand before each provider: documents of an unknown type cost no call after classification.

    Every stage's rows are kept (written and read again) before the next: answers are asked for once."""
    blocks = keep(layout.lines(ocr.tokens(pages)))
    texts = layout.page_texts(blocks)
    classes = keep(classify.classify(model.answer("classification", classify.prompts(blocks, texts, s)), s))
    found = keep(sections.detect(model.answer("section_detection", sections.prompts(blocks, classes, s)), classes, blocks))
    told = keep(extract.checked(found, model.answer("extraction", extract.prompts(found))))
    fields = extract.fields(found, told)
    fields = fields.withColumns({c: F.lit(None).cast(t) for c, t in (("ocr_value", "string"), ("ocr_confidence", "double"), ("vision_value", "string"), ("vision_confidence", "double"), ("vision_source_text", "string"), ("fallback_reason", "string"))} | {"fallback_attempted": F.lit(False)})
    checked = keep(validate.validate(fields, s))
    asked = keep(vision.cropped(checked, blocks, found, pages, s))
    checked = keep(vision.run(checked, vision.clean(model.answer("vision_fallback", vision.prompts(asked))), asked, s))
    issues = keep(validate.issues(checked))
    summed = model.answer("summary", insights.context(checked, issues, s).withColumnRenamed("context", "prompt"))
    wanted = model.answer("action_extraction", insights.action_prompts(checked, s))
    return Result(blocks, classes, found, checked, issues, validate.summary(checked), insights.summaries(classes, checked, summed, s), insights.actions(checked, issues, wanted, old_actions, s))
