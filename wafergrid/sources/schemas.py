"""Fixed schemas of the exchanged tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _s(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_t, _i, _l, _d, _f = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.FloatType()

MANIFEST = _s(**{c: _t for c in ("dataset", "category", "sample_id", "split", "image_path", "label", "mask_path", "box_path", "template_path", "metadata_json")})
FOLD_MANIFEST = T.StructType([*MANIFEST.fields, T.StructField("fold_id", _t), T.StructField("fold_split", _t)])
SCORES = _s(dataset=_t, category=_t, sample_id=_t, label=_t, fold_id=_t, fold_split=_t, image_score=_d, image_path=_t, mask_path=_t, heatmap_path=_t, debug_path=_t)
PIXELS = _s(image_id=_t, y=_i, x=_i, score=_f)
COMPONENTS = _s(image_id=_t, component_ix=_i, x1=_i, y1=_i, x2=_i, y2=_i, grid_w=_i, grid_h=_i, scores=T.ArrayType(_f, False), fusion=_t)
FEATURES = _s(image_id=_t, view=_t, gy=_i, gx=_i, vec=T.ArrayType(_f, False))
BOXES = _s(image_id=_t, line_no=_i, x1=_d, y1=_d, x2=_d, y2=_d, class_id=_i, class_name=_t)
METRICS = _s(path=_t, category=_t, num_images=_l, image_auroc=_d, pixel_auroc=_d, aupro=_d, best_pixel_f1=_d, best_pixel_iou=_d)
