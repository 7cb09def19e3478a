"""Order-and-customer analytics as lazy Spark DataFrame plans."""
