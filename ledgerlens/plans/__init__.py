"""The index as tables: epochs, manifest, output log."""
