"""Command line: prepare a catalog, evaluate, build an index, identify, verify, time an embedder, run queries."""

from __future__ import annotations

import argparse
import importlib
import json

from .checkpoints import cut
from .operators import evaluation, reports
from .operators.matcher import CatalogMatcher, thumbnail_embedder
from .plans import registry
from .session import builder
from .sources import files


def embedder(name: str | None):
    """``module:function`` that returns an embedder; the thumbnail stand-in without a name."""
    if not name:
        return thumbnail_embedder()
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)()


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="latticeq", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("prepare")
    a.add_argument("--roots", nargs="+", required=True)
    a.add_argument("--out", default="work")
    a.add_argument("--short", type=int, default=320)
    a.add_argument("--hash-most", type=int, default=6)
    a.add_argument("--seed", type=int, default=0)
    for name in ("index", "identify", "verify"):
        a = sub.add_parser(name)
        a.add_argument("--embedder")
        a.add_argument("--size", type=int, default=224)
        a.add_argument("--tau", type=float)
        a.add_argument("--images")
        a.add_argument("--gallery", default="gallery")
        a.add_argument("--image")
        a.add_argument("--image2")
        a.add_argument("--topk", type=int, default=5)
    a = sub.add_parser("evaluate")
    a.add_argument("--manifest", required=True)
    a.add_argument("--cache", required=True)
    a.add_argument("--embedder")
    a.add_argument("--gray", action="store_true")
    a.add_argument("--split", default="test")
    a.add_argument("--seed", type=int, default=0)
    a.add_argument("--tta", action="store_true")
    a.add_argument("--size", type=int, default=224)
    a.add_argument("--out", required=True)
    a = sub.add_parser("efficiency")
    a.add_argument("--embedder")
    a.add_argument("--size", type=int, default=224)
    a.add_argument("--out")
    a = sub.add_parser("query")
    a.add_argument("name", choices=sorted(registry.QUERIES))
    a.add_argument("--data", required=True)
    args = p.parse_args(argv)
    spark = builder().getOrCreate()
    if args.command == "prepare":
        manifest, counts = files.prepare(spark, args.roots, hash_most=args.hash_most, seed=args.seed, cache=f"{args.out}/cache")
        manifest = cut(manifest)
        files.write_manifest(manifest, f"{args.out}/manifest")
        files.write_cache(files.decode(spark, *args.roots), args.short, f"{args.out}/cache", manifest)
        counts.show()
        manifest.groupBy("split").count().show()
    elif args.command == "evaluate":
        name = reports.model_name(backbone=args.embedder or "thumbnail", gray=args.gray)
        found = evaluation.evaluate(spark, args.manifest, args.cache, embedder(args.embedder), name, args.out, args.split, args.seed, size=args.size, gray=args.gray, views=args.tta)
        print(json.dumps(found["headline"], indent=2))
    elif args.command == "efficiency":
        found = reports.efficiency(embedder(args.embedder), args.size)
        print(json.dumps(found, indent=2))
        if args.out:
            files.write_document(spark, found, args.out)
    elif args.command == "query":
        registry.QUERIES[args.name](spark, args.data).show(truncate=False)
    else:
        matcher = CatalogMatcher(spark, embedder(args.embedder), args.tau, size=args.size)
        if args.command == "index":
            print(matcher.build_index(args.images, args.gallery).count(), "images indexed")
        elif args.command == "identify":
            for r in matcher.identify(args.image, files.read_index(spark, args.gallery), args.topk).collect():
                print(f"{r['rank']}. {r['label']} {r['score']:.3f} {r['path']}")
        else:
            same, score = matcher.verify(args.image, args.image2)
            print("same design" if same else "different designs", f"{score:.3f}")


if __name__ == "__main__":
    main()
