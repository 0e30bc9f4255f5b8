"""Named queries over the given tables, each with the SQL that checks it where SQL can."""

from catalog import arrays, frames, meshes, objects, records, splits, tracks

MODULES = [objects, frames, tracks, records, arrays, splits, meshes]
