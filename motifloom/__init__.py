"""motifloom: motif search over sequence libraries, expressed as Spark plans."""
