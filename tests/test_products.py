"""Products that titles name: keys, labels, confidence; memory and storage told apart."""

import pytest
from pyspark.sql import functions as F

from stallmetrics.functions import products as P
from stallmetrics.functions import text

TITLES = {
    "Apple iPhone 14 Pro Max 256GB schwarz": ("apple|phone|iphone-14|pro-max|storage-256gb", "Apple · iPhone 14 · Pro Max · 256 GB", 94),
    "iPhone SE 2 64 GB": ("apple|phone|iphone-se-2|storage-64gb", "Apple · iPhone SE 2 · 64 GB", 94),
    "iphone XR": ("apple|phone|iphone-xr", "Apple · iPhone XR", 90),
    "iPhone 16e 128gb": ("apple|phone|iphone-16e|storage-128gb", "Apple · iPhone 16e · 128 GB", 94),
    "iPhone defekt": ("apple|phone|iphone", "Apple · iPhone", 58),
    "iPad Pro 11 Zoll M2 256GB": ("apple|tablet|ipad-pro|storage-256gb|11|m2", 'Apple · iPad Pro · 11" · M2 · 256 GB', 92),
    "iPad 9. Generation": ("apple|tablet|ipad|gen-9", "Apple · iPad · Gen 9", 92),
    "ipad": ("apple|tablet|ipad", "Apple · iPad", 84),
    "Mac Book Pro M3 Max 14 Zoll 36 GB Arbeitsspeicher 1 TB": ("apple|laptop|macbook-pro|ram-36gb|storage-1000gb|14|m3-max", 'Apple · MacBook Pro · 14" · M3 Max · 36 GB RAM · 1 TB', 96),
    "MacBook Pro 8GB 256 GB": ("apple|laptop|macbook-pro|ram-8gb|storage-256gb", "Apple · MacBook Pro · 8 GB RAM · 256 GB", 86),
    "MacBook RAM 16GB SSD: 1,5TB": ("apple|laptop|macbook|ram-16gb|storage-1500gb", "Apple · MacBook · 16 GB RAM · 1.5 TB", 86),
    "Apple TV 4K 3. Gen 128 GB Ethernet": ("apple|streamer|apple-tv-4k|ethernet|storage-128gb|gen-3", "Apple TV 4K · Ethernet · Gen 3 · 128 GB", 96),
    "Air Pods Pro 2. Generation": ("apple|headphones|airpods-pro|gen-2", "Apple · AirPods Pro · Gen 2", 90),
    "Mac mini M1 Ultra 8GB RAM 256GB": ("apple|desktop|mac-mini|ram-8gb|storage-256gb|m1", "Apple · Mac mini · M1 · 8 GB RAM · 256 GB", 92),
    "PlayStation Portal": ("sony|handheld|ps-portal", "Sony · PlayStation Portal", 98),
    "PS5 Slim mit Laufwerk 1TB": ("sony|console|ps5|slim-disc|storage-1000gb", "Sony · PlayStation 5 · Slim Disc · 1 TB", 98),
    "Controller für PS5": ("sony|controller|dualsense", "Sony · DualSense", 92),
    "DualSense Edge": ("sony|controller|dualsense-edge", "Sony · DualSense Edge", 99),
    "Laufwerk für die PS5": ("sony|accessory|ps5-disc-drive", "Sony · PS5 Disc Drive", 93),
    "PS4 500GB": ("sony|console|ps4|storage-500gb", "Sony · PlayStation 4 · 500 GB", 92),
    "X Box Series S 512 GB": ("microsoft|console|xbox-series-s|storage-512gb", "Microsoft · Xbox Series S · 512 GB", 94),
    "xbox gamepad": ("microsoft|controller|xbox-controller", "Microsoft · Xbox Controller", 88),
    "Xbox 360": ("microsoft|console|xbox", "Microsoft · Xbox", 70),
    "Switch 2 OLED": ("nintendo|console|nintendo-switch-2", "Nintendo Switch 2", 96),
    "Nintendo Switch Pro Controller": ("nintendo|controller|switch-controller", "Nintendo · Switch Controller", 88),
    "Steam Deck OLED 512 GB": ("valve|handheld|steam-deck|oled|storage-512gb", "Valve · Steam Deck · OLED · 512 GB", 98),
    "Meta Quest 3S 128 GB": ("meta|headset|meta-quest-3s|storage-128gb", "Meta Quest 3S · 128 GB", 94),
    "Quest Brille, wie quest 3": ("meta|headset|meta-quest", "Meta Quest", 78),
    "Galaxy Z Fold 5": ("samsung|phone|galaxy-z-fold-5", "Samsung · Galaxy Z Fold 5", 92),
    "Samsung Galaxy S 24 FE Plus": ("samsung|phone|galaxy-s24|plus-fe", "Samsung · Galaxy S24 · Plus FE", 92),
    "Google Pixel 8a Pro XL 128GB": ("google|phone|pixel-8a|pro-xl|storage-128gb", "Google · Pixel 8A · Pro XL · 128 GB", 94),
    "RTX 4070 Ti Super": ("nvidia|gpu|rtx-4070|ti-super", "NVIDIA · RTX 4070 · Ti Super", 98),
    "RX 7900 XTX": ("amd|gpu|rx-7900|xtx", "AMD · RX 7900 · XTX", 98),
    "Ryzen 7 7800X3D": ("amd|cpu|ryzen-7-7800x3d", "AMD · Ryzen 7 7800X3D", 99),
    "Intel Core i7-12700K": ("intel|cpu|core-i7-12700k", "Intel · Core i7-12700K", 99),
    "core ultra 7 265k": ("intel|cpu|core-ultra-7-265k", "Intel · Core Ultra 7 265K", 99),
    "Canon EOS 80D Kamera": ("canon|camera|eos80d", "Canon · EOS80D", 58),
    "Lenovo ThinkPad": ("lenovo|laptop|lenovo", "Lenovo", 38),
    "Sofa grau": ("", "", 0),
    "": ("", "", 0),
    None: ("", "", 0),
}


def test_titles(spark):
    rows = spark.createDataFrame([(t,) for t in TITLES], "title string").withColumn("fold", text.folded("title"))
    found = {r.title: (r.p.key, r.p.label, r.p.confidence) for r in rows.select("title", P.recognized(F.col("fold")).alias("p")).collect()}
    assert found == TITLES


@pytest.mark.parametrize(
    ("said", "ram", "storage"),
    [("16gb ram 512gb", 16, 512), ("ram: 16 gb, 512 gb ssd", 16, 512), ("8gb ram 256gb", 8, 256), ("64gb ddr4 1tb nvme", 64, 1000), ("speicher 128gb", None, 128), ("128 gb", None, 128), ("ram 64gb", 64, None), ("arbeitsspeicher 64 gb", 64, 64), ("256gb 0,5tb", None, 500), ("16gbx", None, None)],
)
def test_memory_and_storage(spark, said, ram, storage):
    t = F.lit(said)
    assert tuple(spark.range(1).select(P.ram_size(t), P.storage_size(t, 32, 8000)).first()) == (ram, storage)


def test_category_tells_the_kind(spark):
    rows = spark.createDataFrame([("Bosch nr 7", "x"), ("Sony A7", "Kameras und Camera")], "title string, category string").withColumn("fold", text.folded("title")).withColumn("cat", text.folded("category"))
    assert [r[0] for r in rows.select(P.recognized(F.col("fold"), F.col("cat"))["key"]).collect()] == ["", "sony|camera|a7"]


def test_families(spark):
    rows = spark.createDataFrame([("iPhone 14 128GB",), ("iPhone defekt",), ("",)], "title string").withColumn("fold", text.folded("title"))
    assert [tuple(r[0]) for r in rows.select(P.product_family(F.col("fold"))).collect()] == [("apple|phone|iphone-14|storage-128gb", 94), ("iphone", 60), ("", 0)]
