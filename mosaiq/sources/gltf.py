"""Binary glTF 2.0: reading a file's bytes into plain structures, and writing them again."""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import unquote_to_bytes

import numpy as np

MAGIC, JSON_CHUNK, BIN_CHUNK = 0x46546C67, 0x4E4F534A, 0x004E4942
INSTANCING = "EXT_mesh_gpu_instancing"
#: Fixed values of the format: component types and the numbers of an element.
COMPONENTS = {5120: np.int8, 5121: np.uint8, 5122: np.int16, 5123: np.uint16, 5125: np.uint32, 5126: np.float32}
ELEMENTS = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4, "MAT2": 4, "MAT3": 9, "MAT4": 16}
#: What arrays are written as: by their type, and by how many numbers an element has.
_KINDS, _SHAPES = {np.dtype(v): k for k, v in COMPONENTS.items()}, {1: "SCALAR", 2: "VEC2", 3: "VEC3", 4: "VEC4", 9: "MAT3", 16: "MAT4"}


class GltfError(ValueError):
    """A file that can't be read; its message becomes the row's error."""


@dataclass
class Gltf:
    json: dict[str, Any]
    bin: bytes = b""

    def items(self, kind: str) -> list[dict[str, Any]]:
        return self.json.get(kind) or []

    def accessor(self, ix: int) -> np.ndarray:
        """An accessor's elements, tightly packed, (count, numbers), in their stored type."""
        try:
            a = self.items("accessors")[ix]
            kind, n = np.dtype(COMPONENTS[a["componentType"]]).newbyteorder("<"), ELEMENTS[a["type"]]
        except (IndexError, KeyError, TypeError) as e:
            raise GltfError(f"accessor {ix} is not readable") from e
        base = self._elements(a, a["count"], kind, n, ix) if "bufferView" in a else np.zeros((a["count"], n), kind)
        return self._overlaid(base, a["sparse"], ix) if "sparse" in a else base

    def _elements(self, of: dict[str, Any], count: int, kind: np.dtype, n: int, ix: int) -> np.ndarray:
        """``count`` elements of ``n`` numbers from a view, which may be strided."""
        view, width = self.items("bufferViews")[of["bufferView"]], kind.itemsize * n
        if "extensions" in view:
            raise GltfError("unsupported compression")
        start = view.get("byteOffset", 0) + of.get("byteOffset", 0)
        stride = view.get("byteStride") or width
        if count and start + stride * (count - 1) + width > len(self.bin):
            raise GltfError(f"accessor {ix} reaches beyond its buffer")
        if count and stride == width:
            return np.frombuffer(self.bin, kind, count * n, start).reshape(count, n)
        raw = np.lib.stride_tricks.as_strided(np.frombuffer(self.bin, np.uint8)[start:], (count, width), (stride, 1)) if count else np.zeros((0, width), np.uint8)
        return np.ascontiguousarray(raw).view(kind).reshape(count, n)

    def _overlaid(self, base: np.ndarray, sparse: dict[str, Any], ix: int) -> np.ndarray:
        """``base`` with the elements that a sparse accessor puts in their places."""
        try:
            count, places, values = sparse["count"], sparse["indices"], sparse["values"]
            kind = np.dtype(COMPONENTS[places["componentType"]]).newbyteorder("<")
        except (KeyError, TypeError) as e:
            raise GltfError(f"accessor {ix} is not readable") from e
        at = self._elements(places, count, kind, 1, ix)[:, 0].astype(np.int64)
        if count and (at.min() < 0 or at.max() >= len(base) or (np.diff(at) <= 0).any()):
            raise GltfError(f"accessor {ix} has sparse elements without a place")
        out = base.copy()
        out[at] = self._elements(values, count, base.dtype, base.shape[1], ix)
        return out


def parse(data: bytes) -> Gltf:
    """A GLB's JSON and binary chunk."""
    if len(data) < 20 or struct.unpack_from("<I", data)[0] != MAGIC:
        raise GltfError("not a GLB file")
    version, length = struct.unpack_from("<II", data, 4)
    if version != 2:
        raise GltfError(f"unsupported version {version}")
    at, doc, body = 12, None, b""
    while at + 8 <= min(length, len(data)):
        size, kind = struct.unpack_from("<II", data, at)
        chunk = data[at + 8 : at + 8 + size]
        if len(chunk) < size:
            raise GltfError("the file ends within a chunk")
        if kind == JSON_CHUNK and doc is None:
            try:
                doc = json.loads(chunk)
            except ValueError as e:
                raise GltfError("the JSON chunk is not JSON") from e
        elif kind == BIN_CHUNK and not body:
            body = chunk
        at += 8 + size
    if not isinstance(doc, dict):
        raise GltfError("no JSON chunk")
    return Gltf(doc, body)


def buffer_uris(doc: dict[str, Any]) -> list[str | None]:
    """Where a document's buffers are; None is the file's own binary chunk."""
    return [b.get("uri") for b in doc.get("buffers") or []]


def inline(uri: str) -> bytes:
    """The bytes that a ``data:`` URI holds."""
    head, comma, body = uri.partition(",")
    try:
        return base64.b64decode(unquote_to_bytes(body), validate=True) if head.endswith(";base64") else unquote_to_bytes(body)
    except ValueError as e:
        raise GltfError("a data URI is not base64") from e


def gathered(doc: dict[str, Any], own: bytes, outside: dict[int, bytes]) -> bytes:
    """A GLB of a document, its own binary chunk and the buffers ``outside`` it by number; views then lie in one buffer."""
    doc, body, begin = json.loads(json.dumps(doc)), bytearray(), []
    for i, (uri, b) in enumerate(zip(buffer_uris(doc), doc.get("buffers") or [])):
        data = own if uri is None else inline(uri) if uri.startswith("data:") else outside.get(i)
        if data is None:
            raise GltfError(f"buffer {uri} is missing")
        if len(data) < b.get("byteLength", 0):
            raise GltfError(f"buffer {uri or i} is shorter than it says")
        body += b"\0" * (-len(body) % 4)
        begin.append(len(body))
        body += data
    for v in doc.get("bufferViews") or []:
        if not 0 <= v.get("buffer", 0) < len(begin):
            raise GltfError("a view is of no buffer")
        v |= {"buffer": 0, "byteOffset": v.get("byteOffset", 0) + begin[v.get("buffer", 0)]}
    doc["buffers"] = [{"byteLength": len(body)}] if body else []
    return pack({k: v for k, v in doc.items() if k != "buffers" or v}, bytes(body))


def pack(doc: dict[str, Any], body: bytes) -> bytes:
    """A GLB of a JSON and a binary chunk, both padded to four bytes."""
    text = json.dumps(doc, separators=(",", ":")).encode()
    text += b" " * (-len(text) % 4)
    body += b"\0" * (-len(body) % 4)
    out = struct.pack("<II", len(text), JSON_CHUNK) + text + (struct.pack("<II", len(body), BIN_CHUNK) + body if body else b"")
    return struct.pack("<III", MAGIC, 2, 12 + len(out)) + out


@dataclass(frozen=True)
class Texture:
    """A texture by content: its JSON without references, its sampler's, and its images as (JSON, bytes or None) by where they are named."""

    doc: str
    sampler: str | None
    images: tuple[tuple[str, str, bytes | None], ...]


@dataclass(frozen=True)
class Material:
    """A material by content: its JSON, in which the index of a texture is a place in ``textures``."""

    doc: str
    textures: tuple[Texture, ...] = ()


@dataclass
class Primitive:
    """A primitive's own arrays: attributes by name, indices or None, material or None."""

    attributes: dict[str, np.ndarray]
    indices: np.ndarray | None = None
    material: Material | None = None
    mode: int = 4
    morphs: list[dict[str, np.ndarray]] = field(default_factory=list)


@dataclass
class Node:
    """A mesh placed by translation, rotation (x, y, z, w) and scale, or many times by ``instances`` of them."""

    mesh: int
    t: tuple[float, ...] = (0.0, 0.0, 0.0)
    r: tuple[float, ...] = (0.0, 0.0, 0.0, 1.0)
    s: tuple[float, ...] = (1.0, 1.0, 1.0)
    instances: list[tuple[tuple[float, ...], tuple[float, ...], tuple[float, ...]]] | None = None
    name: str | None = None


def _texture_infos(x: Any) -> Iterator[dict[str, Any]]:
    """Everything within a material that names a texture, its extensions included."""
    if isinstance(x, list):
        for v in x:
            yield from _texture_infos(v)
    elif isinstance(x, dict):
        for k, v in x.items():
            if k.endswith("Texture") and isinstance(v, dict) and isinstance(v.get("index"), int):
                yield v
            yield from _texture_infos(v)


def _sources(texture: dict[str, Any]) -> Iterator[tuple[str, dict[str, Any]]]:
    """Where a texture names images: ("", the texture) and (an extension's name, the extension)."""
    if "source" in texture:
        yield "", texture
    for name, ext in sorted((texture.get("extensions") or {}).items()):
        if isinstance(ext, dict) and "source" in ext:
            yield name, ext


class Writer:
    """Collects meshes and nodes into one GLB. Buffers are aligned; equal arrays, materials, textures, samplers and images are stored once."""

    def __init__(self) -> None:
        self.doc: dict[str, Any] = {"asset": {"version": "2.0", "generator": "mosaiq"}, "scene": 0, "scenes": [{"nodes": []}], "nodes": [], "meshes": [], "accessors": [], "bufferViews": []}
        self.body = bytearray()
        self.seen: dict[tuple, int] = {}
        self.contents: dict[tuple, int] = {}
        self.extensions: set[str] = set()

    def _view(self, data: bytes) -> int:
        self.body += b"\0" * (-len(self.body) % 4)
        self.doc["bufferViews"].append({"buffer": 0, "byteOffset": len(self.body), "byteLength": len(data)})
        self.body += data
        return len(self.doc["bufferViews"]) - 1

    def _stored(self, kind: str, of: Any, make: Callable[[], dict[str, Any]]) -> int:
        """The number of a material, texture, sampler or image, which is made if nothing equal is there."""
        if (kind, of) not in self.contents:
            made = make()
            self.doc.setdefault(kind, []).append(made)
            self.contents[kind, of] = len(self.doc[kind]) - 1
        return self.contents[kind, of]

    def _image(self, doc: str, data: bytes | None) -> int:
        return self._stored("images", (doc, data), lambda: json.loads(doc) | ({"bufferView": self._view(data)} if data is not None else {}))

    def _texture(self, t: Texture) -> int:
        def make() -> dict[str, Any]:
            out = json.loads(t.doc)
            if t.sampler is not None:
                out["sampler"] = self._stored("samplers", t.sampler, lambda: json.loads(t.sampler))
            for name, doc, data in t.images:
                of = out.setdefault("extensions", {}).setdefault(name, {}) if name else out
                of["source"] = self._image(doc, data)
            self.extensions |= set(out.get("extensions") or ())
            return out

        return self._stored("textures", t, make)

    def _material(self, m: Material) -> int:
        def make() -> dict[str, Any]:
            out = json.loads(m.doc)
            for info in _texture_infos(out):
                info["index"] = self._texture(m.textures[info["index"]])
                self.extensions |= set(info.get("extensions") or ())
            self.extensions |= set(out.get("extensions") or ())
            return out

        return self._stored("materials", m, make)

    def _accessor(self, a: np.ndarray, bounds: bool = False) -> int:
        a = np.ascontiguousarray(a)
        a = a[:, None] if a.ndim == 1 else a
        key = (a.dtype.str, a.shape, a.tobytes(), bounds)
        if key in self.seen:
            return self.seen[key]
        view = self._view(a.tobytes())
        out = {"bufferView": view, "componentType": _KINDS[a.dtype.newbyteorder("=")], "count": len(a), "type": _SHAPES[a.shape[1]]}
        if bounds and len(a):
            out |= {"min": a.min(axis=0).astype(float).tolist(), "max": a.max(axis=0).astype(float).tolist()}
        self.doc["accessors"].append(out)
        self.seen[key] = len(self.doc["accessors"]) - 1
        return self.seen[key]

    def mesh(self, primitives: list[Primitive], name: str | None = None) -> int:
        out = []
        for p in primitives:
            x: dict[str, Any] = {"attributes": {k: self._accessor(v, k == "POSITION") for k, v in sorted(p.attributes.items())}, "mode": p.mode}
            if p.indices is not None:
                x["indices"] = self._accessor(p.indices)
            if p.material is not None:
                x["material"] = self._material(p.material)
            if p.morphs:
                x["targets"] = [{k: self._accessor(v, k == "POSITION") for k, v in sorted(m.items())} for m in p.morphs]
            out.append(x)
        self.doc["meshes"].append({"primitives": out} | ({"name": name} if name else {}))
        return len(self.doc["meshes"]) - 1

    def node(self, n: Node) -> None:
        out: dict[str, Any] = {"mesh": n.mesh} | ({"name": n.name} if n.name else {})
        for key, value, neutral in (("translation", n.t, (0, 0, 0)), ("rotation", n.r, (0, 0, 0, 1)), ("scale", n.s, (1, 1, 1))):
            if value != neutral and any(abs(a - b) > 1e-10 for a, b in zip(value, neutral)):
                out[key] = list(map(float, value))
        if n.instances is not None:
            t, r, s = (np.array([i[k] for i in n.instances], np.float32).reshape(-1, (3, 4, 3)[k]) for k in range(3))
            out["extensions"] = {INSTANCING: {"attributes": {"TRANSLATION": self._accessor(t, True), "ROTATION": self._accessor(r), "SCALE": self._accessor(s, True)}}}
            self.extensions.add(INSTANCING)
            self.doc["extensionsRequired"] = [INSTANCING]
        self.doc["scenes"][0]["nodes"].append(len(self.doc["nodes"]))
        self.doc["nodes"].append(out)

    def finish(self) -> bytes:
        if self.extensions:
            self.doc["extensionsUsed"] = sorted(self.extensions)
        self.doc["buffers"] = [{"byteLength": len(self.body)}] if self.body else []
        return pack({k: v for k, v in self.doc.items() if v or k == "scene"}, bytes(self.body))


def _image_of(g: Gltf, ix: int) -> tuple[str, bytes | None]:
    image = dict(g.items("images")[ix])
    view = image.pop("bufferView", None)
    if view is None:
        return json.dumps(image, sort_keys=True), None
    v = g.items("bufferViews")[view]
    at = v.get("byteOffset", 0)
    if at + v["byteLength"] > len(g.bin):
        raise GltfError(f"image {ix} reaches beyond its buffer")
    return json.dumps(image, sort_keys=True), bytes(g.bin[at : at + v["byteLength"]])


def _texture_of(g: Gltf, ix: int) -> Texture:
    doc = json.loads(json.dumps(g.items("textures")[ix]))
    images = [(name, *_image_of(g, of.pop("source"))) for name, of in _sources(doc)]
    sampler = doc.pop("sampler", None)
    return Texture(json.dumps(doc, sort_keys=True), None if sampler is None else json.dumps(g.items("samplers")[sampler], sort_keys=True), tuple(images))


def material_of(g: Gltf, ix: int | None) -> Material | None:
    """A material with all that it refers to; None if there is none of that number."""
    if ix is None or not 0 <= ix < len(g.items("materials")):
        return None
    doc = json.loads(json.dumps(g.items("materials")[ix]))
    places: dict[int, int] = {}
    for info in _texture_infos(doc):
        info["index"] = places.setdefault(info["index"], len(places))
    return Material(json.dumps(doc, sort_keys=True), tuple(_texture_of(g, t) for t in places))


def primitives_of(g: Gltf, mesh: int) -> list[Primitive]:
    """A mesh's primitives with their arrays and materials."""
    out = []
    for p in g.items("meshes")[mesh].get("primitives", []):
        out.append(Primitive(
            {k: g.accessor(v) for k, v in sorted(p.get("attributes", {}).items())},
            g.accessor(p["indices"])[:, 0] if "indices" in p else None,
            material_of(g, p.get("material")),
            p.get("mode", 4),
            [{k: g.accessor(v) for k, v in sorted(t.items())} for t in p.get("targets", [])],
        ))
    return out


#: Lists whose items other parts of a model refer to by number.
_LISTS = ("bufferViews", "accessors", "images", "samplers", "textures", "materials", "meshes", "nodes")


def references(kind: str, x: dict[str, Any]) -> Iterator[tuple[dict[str, Any], str, str]]:
    """(holder, key, list): where an item of a list names an item of another one by number."""
    found: list[tuple[dict[str, Any], str, str]] = []
    if kind in ("accessors", "images"):
        sparse = x.get("sparse") or {}
        found = [(h, "bufferView", "bufferViews") for h in (x, sparse.get("indices") or {}, sparse.get("values") or {})]
    elif kind == "textures":
        found = [(x, "sampler", "samplers"), *[(of, "source", "images") for _, of in _sources(x)]]
    elif kind == "materials":
        found = [(info, "index", "textures") for info in _texture_infos(x)]
    elif kind == "meshes":
        for p in x.get("primitives", []):
            found += [(named, k, "accessors") for named in (p.get("attributes", {}), *p.get("targets", [])) for k in named]
            found += [(p, "indices", "accessors"), (p, "material", "materials")]
    elif kind == "nodes":
        named = (x.get("extensions") or {}).get(INSTANCING, {}).get("attributes", {})
        found = [(x, "mesh", "meshes"), *[(named, k, "accessors") for k in named]]
    return ((holder, key, of) for holder, key, of in found if isinstance(holder.get(key), int))


def merged(sources: list[Gltf]) -> bytes:
    """One GLB of several models: buffers one behind another, every reference moved on by what came before, all roots in one scene."""
    doc: dict[str, Any] = {"asset": {"version": "2.0", "generator": "mosaiq"}, "scene": 0, "scenes": [{"nodes": []}]} | {k: [] for k in _LISTS}
    body, used, required = bytearray(), set(), set()
    for g in sources:
        body += b"\0" * (-len(body) % 4)
        begin = {k: len(doc[k]) for k in _LISTS}
        own = {k: json.loads(json.dumps(g.items(k))) for k in _LISTS}
        for v in own["bufferViews"]:
            v |= {"buffer": 0, "byteOffset": v.get("byteOffset", 0) + len(body)}
        for kind in _LISTS:
            for holder, key, of in (r for x in own[kind] for r in list(references(kind, x))):
                holder[key] += begin[of]
        for n in own["nodes"]:
            n |= {"children": [c + begin["nodes"] for c in n["children"]]} if n.get("children") else {}
            # Skins and cameras are no part of what is merged.
            n.pop("skin", None), n.pop("camera", None)
        for k in _LISTS:
            doc[k] += own[k]
        doc["scenes"][0]["nodes"] += [r + begin["nodes"] for r in roots_of(g)]
        body += g.bin
        used |= set(g.json.get("extensionsUsed") or ())
        required |= set(g.json.get("extensionsRequired") or ())
    doc |= {"buffers": [{"byteLength": len(body)}] if body else [], "extensionsUsed": sorted(used), "extensionsRequired": sorted(required)}
    return pack({k: v for k, v in doc.items() if v or k == "scene"}, bytes(body))


def roots_of(g: Gltf) -> list[int]:
    """Where a walk begins: the roots of the default scene (the first, if none is named), else of all scenes, else the nodes without a parent, else all nodes."""
    scenes, nodes = g.items("scenes"), g.items("nodes")
    at = g.json.get("scene", 0)
    children = {c for n in nodes for c in n.get("children", [])}
    choices = (
        scenes[at].get("nodes", []) if 0 <= at < len(scenes) else [],
        list(dict.fromkeys(r for s in scenes for r in s.get("nodes", []))),
        [i for i in range(len(nodes)) if i not in children],
        range(len(nodes)),
    )
    return next(([r for r in c if 0 <= r < len(nodes)] for c in choices if c), [])


def cube() -> Primitive:
    """A unit cube around the origin: four corners and two triangles per face."""
    corners, normals, indices = [], [], []
    for axis in range(3):
        for sign in (-0.5, 0.5):
            u, v = (axis + 1) % 3, (axis + 2) % 3
            for a, b in ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)):
                p, n = [0.0] * 3, [0.0] * 3
                p[axis], p[u], p[v], n[axis] = sign, a, b, 2 * sign
                corners.append(p)
                normals.append(n)
            face = [0, 1, 2, 0, 2, 3] if sign > 0 else [0, 2, 1, 0, 3, 2]
            indices += [len(corners) - 4 + i for i in face]
    return Primitive({"POSITION": np.array(corners, np.float32), "NORMAL": np.array(normals, np.float32)}, np.array(indices, np.uint16))
