"""Schemas of the records that are read and written, as Spark DDL."""

from __future__ import annotations

POINTS = "array<array<double>>"
#: confidence is read as text and coerced later: numeric text counts, anything else is 0.
RAW_ITEM = f"struct<box:{POINTS}, text:string, confidence:string>"
ITEM = f"struct<box:{POINTS}, text:string, confidence:double>"
PAGE = f"struct<dt_polys:array<{POINTS}>, rec_texts:array<string>, rec_scores:array<double>>"
BBOX = "struct<x:int, y:int, w:int, h:int>"
CANDIDATE = "struct<text:string, confidence:double, index:int, raw_text:string>"
PROFILING = "struct<path:string, decode_ms:double, label_detect_ms:double, crop_ms:double, seg_ms:double, ocr_ms:double, mobile_ocr_ms:double, fallback_ocr_ms:double, selected_score:double, total_ms:double>"
CONFIDENCE = "struct<seat:double, name:double, combined:double>"
VALIDATION_ATTEMPT = f"struct<stage:string, engine:string, bbox:{BBOX}, output_count:int, ocr_ms:double, accepted:boolean, parse_reason:string, score:double, selected_seat:{CANDIDATE}, selected_name:{CANDIDATE}, confidence:{CONFIDENCE}, error:string>"
LABEL_DETECTION = f"struct<strategy:string, selected_pass:string, selected_bbox:{BBOX}, validation_attempts:array<{VALIDATION_ATTEMPT}>>"
ARTIFACT = "struct<filename:string, relative_path:string, enabled:boolean, required:boolean, saved:boolean>"
#: results stays JSON text until parsed, as a response may hold something that is no list.
RESPONSE = f"results string, profiling {PROFILING}, debug struct<request_id:string, attempt_number:int, label_detection:{LABEL_DETECTION}>, error string"
DIAGNOSTIC = f"request_id string, timestamp_utc string, attempt struct<number:int, dir_name:string, artifacts_dir:string>, profiling {PROFILING}, artifacts map<string, {ARTIFACT}>, image_shape struct<width:int, height:int>, label_detection {LABEL_DETECTION}, ocr struct<path:string, output_count:int, output_preview:array<{ITEM}>>, error string"
