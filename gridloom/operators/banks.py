"""Filter banks at their full reach."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.functions import filters


def bank_responses(images: DataFrame, bank: dict[str, tuple]) -> DataFrame:
    """(image_id, filter, rows, columns, data): the response of every cell to every filter (kind, scale, angle), with a replicated border.

    ``images`` are packed, (image_id, data, rows, columns). A kernel reaches up to 7 scales, often further than the image does, so sums are made
    by Fourier transforms: one of the padded image, one product and one inverse for each filter, whatever the kernel's size. Kernels are made in the tasks from the
    bank's parameters and kept for each image size. A task holds one image at a time with its responses to one filter.

    An image without cells has empty responses; null data are left out.
    """
    kinds = f"image_id {dict(images.dtypes)['image_id']}, filter string, rows int, columns int, data array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernels = {n: np.array(filters.kernel(*spec)) for n, spec in bank.items()}
        reach = max((k.shape[0] // 2 for k in kernels.values()), default=0)
        made: dict[tuple[int, int], dict[str, np.ndarray]] = {}
        for b in batches:
            for row in b.to_pylist():
                shape = row["rows"], row["columns"]
                size = shape[0] + 2 * reach, shape[1] + 2 * reach
                if shape not in made:
                    made[shape] = {}
                    for n, k in kernels.items():
                        at = np.zeros(size)
                        at[: k.shape[0], : k.shape[1]] = k
                        half = k.shape[0] // 2
                        made[shape][n] = np.conj(np.fft.rfft2(np.roll(at, (-half, -half), (0, 1))))
                padded = np.pad(np.array(row["data"], float).reshape(shape), reach, mode="edge")
                image = np.fft.rfft2(padded)
                out = [np.fft.irfft2(image * k, size)[reach : reach + shape[0], reach : reach + shape[1]].ravel() for k in made[shape].values()]
                n = len(out)
                yield pa.RecordBatch.from_arrays([pa.array([row["image_id"]] * n, b.column(0).type), pa.array(list(made[shape]), pa.string()), pa.array([shape[0]] * n, pa.int32()), pa.array([shape[1]] * n, pa.int32()), pa.array(out, pa.list_(pa.float64()))], ["image_id", "filter", "rows", "columns", "data"])

    return images.filter("data is not null and size(data) > 0").select("image_id", "data", "rows", "columns").mapInArrow(run, kinds)
