"""python -m tidemark INPUT_FOLDER OUTPUT_FOLDER [--preserve-order]"""

import sys

from tidemark.engine import run_batch
from tidemark.session import local_session

if __name__ == "__main__":
    folders = [x for x in sys.argv[1:] if not x.startswith("--")]
    if len(folders) != 2:
        sys.exit(__doc__)
    done = run_batch(local_session("*"), *folders, preserve_order="--preserve-order" in sys.argv)
    for o in done:
        print(f"query{o.number}: {o.error or f'{o.rows} rows'}")
    sys.exit(any(o.error for o in done))
