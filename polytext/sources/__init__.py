"""Sources and sinks: JSON entry files, text lines, parallel text files, TSV
vocabularies, sharded outputs with manifests and hypothesis caches."""
