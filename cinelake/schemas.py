"""Schemas of the engine's tables; never inferred.

Absent text attributes are ``''``, not null; only ranges, target durations and
init segments are null where a manifest has none. ``pos`` gives the order.
"""

from __future__ import annotations

from pyspark.sql.types import _parse_datatype_string as _parse

MANIFESTS = "manifest_id string, url string, body string"
ENCRYPTION = "struct<method: string, key: binary, iv: binary, key_id: binary, key_url: string, key_format: string>"
STREAMS = (
    "manifest_id string, stream_idx int, media_type string, group_id string, language string, name string, bandwidth bigint, codecs string, "
    "resolution string, frame_rate double, channels string, extension string, video_range string, role string, url string, segments_count bigint"
)
PLAYLISTS = (
    "manifest_id string, stream_idx int, is_live boolean, refresh_ms double, total_duration_s double, target_duration_s double, "
    "init struct<url: string, range_start: bigint, range_len: bigint>"
)
SEGMENTS = (
    "manifest_id string, stream_idx int, part_idx int, pos int, seg_index bigint, duration_s double, url string, "
    f"range_start bigint, range_len bigint, enc {ENCRYPTION}"
)
CUES = "doc_id string, pos int, id string, start_us bigint, end_us bigint, text string, settings string"
BOXES = "file_id string, path array<string>, depth int, pos int, box_type string, size bigint, offset bigint, body binary"
TS_PACKETS = "file_id string, n bigint, pid int, pusi boolean, adaptation int, payload binary"
SAMPLES = "track_id string, idx int, pts bigint, dts bigint, duration bigint, is_key boolean, data binary"
TRANSFERS = "task_id string, pos int, bytes bigint, at timestamp"
COMPLETED = "task_id string, pos int, path string"

#: A manifest as XML, for ``from_xml``: attributes have a leading underscore.
_INIT = "struct<_sourceURL: string, _range: string>"
_TEMPLATE = (
    "struct<_timescale: string, _initialization: string, _media: string, _startNumber: string, _duration: string, "
    "SegmentTimeline: struct<S: array<struct<_t: string, _d: string, _r: string>>>>"
)
_LIST = f"struct<_timescale: string, _duration: string, _startNumber: string, Initialization: {_INIT}, SegmentURL: array<struct<_media: string, _mediaRange: string>>>"
_BASE = f"struct<_timescale: string, _indexRange: string, Initialization: {_INIT}>"
_REPRESENTATION = (
    "struct<_id: string, _bandwidth: string, _codecs: string, _width: string, _height: string, _frameRate: string, _audioSamplingRate: string, "
    f"SegmentTemplate: {_TEMPLATE}, SegmentList: {_LIST}, SegmentBase: {_BASE}, BaseURL: array<string>>"
)
_ADAPTATION = (
    f"struct<_id: string, _contentType: string, _mimeType: string, _lang: string, Representation: array<{_REPRESENTATION}>, "
    f"SegmentTemplate: {_TEMPLATE}, SegmentList: {_LIST}, SegmentBase: {_BASE}, "
    "ContentProtection: array<struct<_schemeIdUri: string, _value: string, `_cenc:default_KID`: string>>>"
)
MPD = f"struct<_type: string, _mediaPresentationDuration: string, Period: array<struct<_id: string, _start: string, _duration: string, AdaptationSet: array<{_ADAPTATION}>>>>"
ISM = (
    "struct<_Duration: string, _IsLive: string, StreamIndex: array<struct<_Type: string, _Name: string, _Language: string, _Chunks: string, "
    "QualityLevel: array<struct<_Index: string, _Bitrate: string, _FourCC: string, _MaxWidth: string, _MaxHeight: string, _SamplingRate: string, _Channels: string>>, "
    "c: array<struct<_d: string, _t: string>>>>>"
)
TTML = "struct<body: struct<div: array<struct<p: array<struct<_begin: string, _end: string, _VALUE: string, span: array<struct<_begin: string, _end: string, _VALUE: string>>>>>>>>"


def struct(ddl: str):
    """The ``StructType`` of one of the schemas above."""
    return _parse(ddl)
