"""Schemas of the tables the jobs read and write."""

from __future__ import annotations

INVENTORY = ("path string, filename string, duration_sec double, width int, height int, fps double, "
             "file_size_mb double, codec string, pose_extracted boolean")
CUES = "stem string, cue_no bigint, start_ms bigint, end_ms bigint, text string"
ANNOTATIONS = "stem string, tier string, start_ms bigint, end_ms bigint, value string"
GLOSSARY = "map<string, struct<lemma: string, forms: array<string>, pos: string, notes: string>>"
MANIFEST = ("npz_path string, segment_id string, text string, label string, n_frames int, n_landmarks int, "
            "source string, angle string")
LANDMARK_LINE = "frame bigint, timestamp double, landmarks array<array<double>>"
POST = ("id bigint, title struct<rendered: string>, content struct<rendered: string>, date string, slug string, "
        "link string, categories array<bigint>")
SIDECAR = ("id string, title string, description string, uploader string, upload_date string, duration double, "
           "webpage_url string, url string")
MEDIA = "array<struct<id: bigint, title: struct<rendered: string>, source_url: string>>"
ANNOTATION_DOCUMENT = (
    "TIME_ORDER struct<TIME_SLOT: array<struct<_TIME_SLOT_ID: string, _TIME_VALUE: bigint>>>, "
    "TIER array<struct<_TIER_ID: string, ANNOTATION: array<struct<ALIGNABLE_ANNOTATION: struct<"
    "_ANNOTATION_ID: string, _TIME_SLOT_REF1: string, _TIME_SLOT_REF2: string, ANNOTATION_VALUE: string>>>>>, "
    "_corrupt string")

ALIGNMENT_TEXT = ["segment_id", "video_path", "pose_path", "vtt_path", "text", "reviewed_text", "status"]
ALIGNMENT_WHOLE = ["start_ms", "end_ms", "frame_start", "frame_end", "n_frames", "reviewed_start_ms", "reviewed_end_ms"]
PAIRING_TEXT = ["pairing_id", "segment_id", "video_path", "pose_path", "hand", "word", "gloss_id", "status",
                "suggestion_gloss", "note", "mouthing"]
PAIRING_WHOLE = ["sign_start_ms", "sign_end_ms", "sign_frame_start", "sign_frame_end"]
PAIRING_REAL = ["motion_confidence", "suggestion_confidence", "fps"]
