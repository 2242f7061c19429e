"""``python -m docfold``: init, add, run, restore, test."""

from __future__ import annotations

import argparse
import shutil
import subprocess
import sys
from pathlib import Path

from docfold import config as C
from docfold.clients import client_of
from docfold.operators.schema import infer
from docfold.pipeline import Pipeline
from docfold.session import session
from docfold.sinks.ledger import Ledger, export

SAMPLES = {
    "schemas/characters.yaml": "actors:\n  <name>:\n    name: \"\"\n    trigger_keywords: []\n    details: {}\n",
    "schemas/world.yaml": "worldinfo:\n  <name>:\n    trigger_keywords: []\n    content: \"\"\n    type: \"\"\n",
    "prompts/base.md": "Read the chapters and update the document.\n\n{{output_rules}}\n\nSchema:\n{{schema_text}}\n\nKnown:\n{{existing_yaml}}\n\nWorld:\n{{existing_worldinfo}}\n\nroot_key: {{root_key}}\n\n{{source_text}}\n",
    "prompts/retry_format.md": "The last answer was no valid YAML ({{error_summary}}). Answer with YAML only.\n\n{{output_rules}}\n\nroot_key: {{root_key}}\n\n{{source_text}}\n",
    "prompts/retry_schema.md": "The last answer broke the schema ({{error_summary}}).\n\nSchema:\n{{schema_text}}\n\n{{output_rules}}\n\nroot_key: {{root_key}}\n\n{{source_text}}\n",
}


def init(path: Path, force: bool = False) -> int:
    if path.exists() and not force:
        print(f"{path} exists; --force replaces it")
        return 1
    for name, content in SAMPLES.items():
        at = path.parent / name
        at.parent.mkdir(parents=True, exist_ok=True)
        if not at.exists():
            at.write_text(content, encoding="utf-8")
    (path.parent / "input").mkdir(exist_ok=True)
    C.save(C.AppConfig(schema_paths=("schemas/characters.yaml", "schemas/world.yaml"), prompt_templates=tuple(n for n in SAMPLES if n.startswith("prompts/"))), path)
    return 0


def add(path: Path, book: Path) -> int:
    if not book.is_file():
        print(f"{book} is no file")
        return 1
    to = path.parent / "input" / book.name
    to.parent.mkdir(exist_ok=True)
    if to.resolve() != book.resolve():
        shutil.copyfile(book, to)
    raw = C.yaml.safe_load(path.read_text(encoding="utf-8")) or {}
    name, have = f"input/{book.name}", list(raw.get("input_epubs") or ())
    if name not in have:  # nothing else of the file changes
        C.write(raw | {"input_epubs": [*have, name]}, path)
    return 0


def schemas_of(c: C.AppConfig, base: Path) -> list[dict]:
    out = []
    for name in c.schema_paths:
        text = (base / name).read_text(encoding="utf-8")
        root, _, sample = infer(text)
        out.append({"schema": Path(name).stem, "root_key": root, "schema_text": text, "sample": sample})
    return out


def templates_of(c: C.AppConfig, base: Path) -> list[dict]:
    from docfold.operators.control import TEMPLATE_ORDER

    rank = {n: i for i, n in enumerate(TEMPLATE_ORDER)}
    paths = sorted((Path(n) for n in c.prompt_templates), key=lambda p: (rank.get(p.name, len(rank)), p.name))
    return [{"name": p.stem, "content": (base / p).read_text(encoding="utf-8")} for p in paths]


def run(path: Path) -> int:
    from docfold.sources.epub import read_epubs

    c, base = C.load(path), path.parent
    if not c.input_epubs or not c.schema_paths:
        print("nothing to do: no books or no schemas")
        return 0
    spark = session()
    ledger = Ledger(spark, str((base / c.workspace_root).resolve()))
    schemas = schemas_of(c, base)
    chapters = read_epubs(spark, *[str((base / b).resolve()) for b in c.input_epubs])
    progress = Pipeline(ledger, schemas, templates_of(c, base), client_of(c.model), c).run(chapters)
    failed = 0
    for p in progress.orderBy("book", "schema").toLocalIterator():
        failed += p.status == "failed"
        if c.emit_console_progress:
            print(f"[{p.status}] {p.book} {p.schema} {p.last_completed}/{p.total} {p.batch_id} merged={p.replaced_nodes} appended={p.appended_nodes}" + f" error={p.last_error}" * bool(p.last_error))
    return 2 if failed else 0


def restore(path: Path, book: str, schema: str, checkpoint: str | None, latest: bool) -> int:
    from docfold.sources.epub import book_id

    c = C.load(path)
    ledger = Ledger(session(), str((path.parent / c.workspace_root).resolve()))
    got = ledger.restore(book_id(str((path.parent / book).resolve())), Path(schema).stem, c.batching.checkpoint_every_n_chapters, checkpoint, latest)
    export(ledger.documents(c.merge), f"{ledger.root}/output")
    print(f"restored {got}")
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="docfold")
    p.add_argument("--config", type=Path, default=Path("config.yaml"))
    sub = p.add_subparsers(dest="command")
    sub.add_parser("init").add_argument("--force", action="store_true")
    sub.add_parser("add-epub").add_argument("path", type=Path)
    sub.add_parser("run")
    r = sub.add_parser("restore")
    r.add_argument("--epub", required=True)
    r.add_argument("--schema", required=True)
    one = r.add_mutually_exclusive_group(required=True)
    one.add_argument("--checkpoint")
    one.add_argument("--latest", action="store_true")
    sub.add_parser("test")
    a = p.parse_args(argv)
    if a.command == "init":
        return init(a.config, a.force)
    if a.command == "add-epub":
        return add(a.config, a.path)
    if a.command == "restore":
        return restore(a.config, a.epub, a.schema, a.checkpoint, a.latest)
    if a.command == "test":
        return subprocess.run([sys.executable, "-m", "pytest", "tests", "-q"]).returncode
    return run(a.config)
