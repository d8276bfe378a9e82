"""Reading collections of sets, and writing pairs."""
