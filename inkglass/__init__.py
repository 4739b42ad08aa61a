"""inkglass: document and file analytics as Spark DataFrame programs."""
