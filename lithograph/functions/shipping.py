"""Sending the library to the executors, once for each application."""

from __future__ import annotations

import io
import pathlib
import uuid
import zipfile

import lithograph
from pyspark.sql import SparkSession

from lithograph.functions import files as fs
from lithograph.functions.storage import kept_folder

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Executors import this package from an archive in the shared folder, so their Python path need not have it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = pathlib.Path(lithograph.__file__).parent
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent).as_posix())
    # A name of its own: a worker that lives on from an earlier application has that one's archive on its path.
    name = f"{kept_folder(spark, 'packages')}/lithograph-{uuid.uuid4().hex}.zip"
    fs.write_bytes(spark, name, raw.getvalue())
    context.addPyFile(name)
    _SHIPPED.add(context.applicationId)
