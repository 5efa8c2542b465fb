"""Schemas as files: the JSON and text forms of schema metadata for features, as other tools write them."""

from __future__ import annotations

import json
import re
from typing import Any

from .dtypes import ElementType, dtype
from .schema import ColumnSchema, Schema

#: Names of the kinds of features, and of the keys that hold what the format has no field for.
INT, FLOAT, UNKNOWN = "INT", "FLOAT", "TYPE_UNKNOWN"
DIMS, IS_LIST, IS_RAGGED, ITEM_SIZE, EXACT = "_dims", "is_list", "is_ragged", "dtype_item_size", "dtype"
CATEGORICAL = "categorical"


def to_features(schema: Schema) -> list[dict]:
    out = []
    for c in schema:
        kind = c.dtype.element_type
        f: dict[str, Any] = {"name": c.name}
        if kind in (ElementType.Int, ElementType.UInt):
            f["type"] = INT
        elif kind == ElementType.Float:
            f["type"] = FLOAT
        if c.value_count is not None:
            f["valueCount"] = {k: v for k, v in (("min", c.value_count.min), ("max", c.value_count.max)) if v is not None}
        rest = {k: v for k, v in c.properties.items() if k not in ("domain", "value_count")}
        if c.domain is not None:
            domain = {k: v for k, v in (("name", c.domain.name), ("min", c.domain.min), ("max", c.domain.max)) if v is not None}
            if f.get("type") == INT:
                f["intDomain"] = domain | ({"isCategorical": True} if CATEGORICAL in c.tags else {})
            elif f.get("type") == FLOAT:
                f["floatDomain"] = domain
            else:
                rest["domain"] = c.properties["domain"]
        rest |= {IS_LIST: c.is_list, IS_RAGGED: c.is_ragged, DIMS: c.shape.as_tuple}
        if c.dtype.element_size:
            rest[ITEM_SIZE] = c.dtype.element_size
        rest[EXACT] = c.dtype.name
        f["annotation"] = {"tag": [str(t) for t in c.tags], "extraMetadata": [rest]}
        out.append(f)
    return out


def to_json(schema: Schema) -> str:
    return json.dumps({"feature": to_features(schema)}, indent=1, default=str)


def _whole(x: Any) -> Any:
    """Numbers that other tools have turned into floats."""
    if isinstance(x, float) and x.is_integer():
        return int(x)
    if isinstance(x, list | tuple):
        return [_whole(y) for y in x]
    return x


def from_features(features: list[dict]) -> Schema:
    out = []
    for f in features:
        note = f.get("annotation", {})
        extra: dict[str, Any] = {}
        for m in note.get("extraMetadata", []):
            extra |= {k: v for k, v in m.items() if k != "@type"} if "value" not in m or not isinstance(m["value"], dict) else m["value"]
        tags = list(note.get("tag", []))
        exact, size, dims = extra.pop(EXACT, None), _whole(extra.pop(ITEM_SIZE, None)), _whole(extra.pop(DIMS, None))
        is_list, is_ragged = extra.pop(IS_LIST, None), extra.pop(IS_RAGGED, None)
        kind = f.get("type")
        if exact is not None:
            named = dtype(exact)
        elif kind in (INT, 2, "2"):
            named = dtype(f"int{size or 64}")
        elif kind in (FLOAT, 3, "3"):
            named = dtype(f"float{size or 64}")
        else:
            named = dtype("unknown")
        for key, whole in (("intDomain", True), ("floatDomain", False)):
            if key in f:
                d = f[key]
                if d.get("isCategorical") and CATEGORICAL not in tags:
                    tags.append(CATEGORICAL)
                extra["domain"] = {k: (int(d[k]) if whole else float(d[k])) if k != "name" else d[k] for k in ("min", "max", "name") if k in d}
        count = f.get("valueCount")
        if dims is not None:
            dims = [tuple(d) if isinstance(d, list) else d for d in dims]
            out.append(ColumnSchema(f["name"], tags, extra, named, dims=dims))
            continue
        if count:
            extra["value_count"] = {k: int(v) for k, v in count.items() if k in ("min", "max")}
            is_list, is_ragged = None, None
        out.append(ColumnSchema(f["name"], tags, extra, named, is_list=is_list or None, is_ragged=is_ragged or None))
    return Schema(out)


def from_json(text: str) -> Schema:
    return from_features(json.loads(text).get("feature", []))


# the text form

_SNAKE = {"valueCount": "value_count", "intDomain": "int_domain", "floatDomain": "float_domain", "isCategorical": "is_categorical", "extraMetadata": "extra_metadata"}
_CAMEL = {v: k for k, v in _SNAKE.items()}
_STRUCT = "type.googleapis.com/google.protobuf.Struct"


def _pack(extra: dict) -> dict:
    """Extra metadata as a serialised message, where protobuf is there; as JSON in its place otherwise."""
    try:
        from google.protobuf import json_format, struct_pb2

        message = json_format.ParseDict(json.loads(json.dumps(extra, default=str)), struct_pb2.Struct())
        return {"type_url": _STRUCT, "value": message.SerializeToString(deterministic=True)}
    except ImportError:
        return {"type_url": "json", "value": json.dumps(extra, default=str).encode()}


def _unpack(entry: dict) -> dict:
    raw = entry.get("value", b"")
    if entry.get("type_url") == "json":
        return json.loads(raw)
    from google.protobuf import json_format, struct_pb2

    return json_format.MessageToDict(struct_pb2.Struct.FromString(raw))


def _escape(raw: bytes) -> str:
    return "".join(chr(b) if 32 <= b < 127 and b not in b'"\\' else f"\\{b:03o}" for b in raw)


def _write(value: Any, key: str, depth: int) -> list[str]:
    pad = "  " * depth
    if isinstance(value, list):
        return [line for v in value for line in _write(v, key, depth)]
    if isinstance(value, dict):
        return [f"{pad}{key} {{", *(line for k, v in value.items() for line in _write(v, _SNAKE.get(k, k), depth + 1)), f"{pad}}}"]
    if key == "type" and depth == 1:
        return [f"{pad}{key}: {value}"]
    if isinstance(value, bytes | str):
        return [f'{pad}{key}: "{_escape(value if isinstance(value, bytes) else value.encode())}"']
    return [f"{pad}{key}: {json.dumps(value)}"]


def to_text(schema: Schema) -> str:
    features = to_features(schema)
    for f in features:
        f["annotation"]["extraMetadata"] = [_pack(m) for m in f["annotation"]["extraMetadata"]]
    return "\n".join(line for f in features for line in _write(f, "feature", 0)) + "\n"


_TOKEN = re.compile(r'\s+|#[^\n]*|(?P<text>"(?:[^"\\]|\\.)*")|(?P<word>[^\s{}:<>\[\],;"]+)|(?P<mark>[{}:<>])|[\[\],;]')


def _unescape(text: str) -> bytes:
    simple = {"n": b"\n", "t": b"\t", "r": b"\r", '"': b'"', "\\": b"\\", "'": b"'"}
    out, i = b"", 0
    while i < len(text):
        if text[i] != "\\":
            out += text[i].encode()
            i += 1
        elif m := re.match(r"\\([0-7]{1,3})", text[i:]):
            out += bytes([int(m[1], 8)])
            i += len(m[0])
        elif m := re.match(r"\\x([0-9a-fA-F]{1,2})", text[i:]):
            out += bytes([int(m[1], 16)])
            i += len(m[0])
        else:
            out += simple.get(text[i + 1], text[i + 1].encode())
            i += 2
    return out


def _parse(tokens: list[tuple[str, str]], at: int = 0) -> tuple[dict[str, list], int]:
    out: dict[str, list] = {}
    while at < len(tokens) and tokens[at][1] not in ("}", ">"):
        key = tokens[at][1]
        at += 1
        if tokens[at][1] == ":":
            at += 1
        kind, value = tokens[at]
        if kind == "mark" and value in "{<":
            inner, at = _parse(tokens, at + 1)
            at += 1
            out.setdefault(key, []).append(inner)
            continue
        at += 1
        out.setdefault(key, []).append(_unescape(value[1:-1]) if kind == "text" else {"true": True, "false": False}.get(value, float(value) if re.fullmatch(r"[-+]?[\d.]+(e[-+]?\d+)?f?", value, re.I) else value))
    return out, at


def from_text(text: str) -> Schema:
    tokens = [(m.lastgroup, m[0]) for m in _TOKEN.finditer(text) if m.lastgroup]
    parsed, _ = _parse(tokens)
    one = lambda d, k, default=None: d.get(k, [default])[-1]
    plain = lambda v: v.decode() if isinstance(v, bytes) else _whole(v)
    features = []
    for f in parsed.get("feature", []):
        out: dict[str, Any] = {"name": plain(one(f, "name"))}
        if "type" in f:
            out["type"] = one(f, "type")
        for key in ("value_count", "int_domain", "float_domain"):
            if key in f:
                out[_CAMEL[key]] = {_CAMEL.get(k, k): plain(v[-1]) for k, v in one(f, key).items()}
        note = one(f, "annotation", {})
        extra = [_unpack({k: (v[-1] if k == "value" else plain(v[-1])) for k, v in m.items()}) for m in note.get("extra_metadata", [])]
        out["annotation"] = {"tag": [plain(t) for t in note.get("tag", [])], "extraMetadata": extra}
        features.append(out)
    return from_features(features)
