"""Command line: files or folders in, smaller files out. Of a pair of flags the last one counts; what is not said is the library's default."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from leafmill.operators.policy import Options

#: Option, field, and whether it has a flag that turns it off.
SWITCHES = {
    "pack-objects": "pack", "downsample-flate": "downsample_flate", "subset-fonts": "subset_fonts", "jbig2": "jbig2", "allow-lossy": "allow_lossy",
    "strip-accessibility": "strip_accessibility", "strip-metadata": "strip_metadata", "strip-private-data": "strip_private_data", "flatten-forms": "flatten_forms",
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="leafmill", description="Makes PDF files smaller; a file that would not shrink is written as it is.")
    p.add_argument("inputs", nargs="+", type=Path)
    p.add_argument("-o", "--output", type=Path, help="the output of a single input")
    p.add_argument("--output-dir", type=Path)
    p.add_argument("--suffix", default="-small")
    p.add_argument("--force", action="store_true", help="overwrite what exists")
    p.add_argument("--target-dpi", type=float)
    p.add_argument("--quality", type=int)
    p.add_argument("--figure-dpi", type=float)
    p.add_argument("--signatures", choices=("warn", "ignore"))
    for flag, name in SWITCHES.items():
        p.add_argument(f"--{flag}", dest=name, action="store_true", default=None)
        p.add_argument(f"--no-{flag}", dest=name, action="store_false", default=None)
    return p


def options(args: argparse.Namespace) -> Options:
    said = {k: v for k in (*SWITCHES.values(), "target_dpi", "quality", "figure_dpi", "signatures") if (v := getattr(args, k)) is not None}
    return Options().with_(**said)


def inputs(path: Path) -> list[Path]:
    """The PDF files of a folder, by extension in either case, in order and not below it; or the path itself."""
    return sorted(x for x in path.iterdir() if x.is_file() and x.suffix.lower() == ".pdf") if path.is_dir() else [path]


def output_of(source: Path, args: argparse.Namespace) -> Path:
    if args.output:
        return args.output
    return (args.output_dir / source.name) if args.output_dir else source.with_name(f"{source.stem}{args.suffix}{source.suffix}")


def one(source: Path, args: argparse.Namespace, own: Options) -> str:
    """Rewrites one file; returns a line about it, or raises ValueError or OSError."""
    import os
    import tempfile

    from leafmill.functions.document import optimize
    from leafmill.sources.pdf import sniff

    data = source.read_bytes()
    if not sniff(data):
        raise ValueError("no PDF header")
    target = output_of(source, args)
    if target.exists() and not args.force:
        raise ValueError(f"{target} exists; --force overwrites it")
    made = optimize(data, own)
    target.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile(dir=target.parent, prefix=f".{target.name}.", delete=False) as part:
        part.write(made.output)
    os.replace(part.name, target)
    warned = f" Signatures that no longer hold: {len(made.signatures)}." if made.rewritten and made.signatures else ""
    return f"{source}: {len(data)} -> {len(made.output)} bytes.{warned}"


def main(argv: list[str] | None = None) -> int:
    """0 if every file has been written."""
    args = parser().parse_args(argv)
    try:
        own = options(args)
        files = [f for p in args.inputs for f in inputs(p)]
    except (OSError, ValueError) as error:
        print(error, file=sys.stderr)
        return 2
    if args.output and len(files) != 1:
        print("-o needs a single input", file=sys.stderr)
        return 2
    failed = 0
    for f in files:
        try:
            print(one(f, args, own), file=sys.stderr)
        except (OSError, ValueError) as error:
            failed += 1
            print(f"{f}: {error}", file=sys.stderr)
    if len(files) > 1:
        print(f"{len(files) - failed} of {len(files)} files written", file=sys.stderr)
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
