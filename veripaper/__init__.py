"""Paper verification analytics as Spark jobs over tables of papers."""
