"""Planning on the driver: periods, load windows, partitions and chains."""
