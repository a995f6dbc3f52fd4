"""The sign catalogue: types, database codes, names and class lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Database code of each sign type, one a line.
_CODES = """
1.1 10111
1.2 10112
1.5 11119
1.6 11120
1.7 11121
1.8 10117
1.9 10114
1.10 111122
1.11.1 11123
1.11.2 11124
1.12.1 11125
1.12.1-1.12.2 11125
1.12.2 11125
1.13 10115
1.14 10116
1.15 11127
1.16 11128
1.17 11129
1.19 11140
1.20.1 11130
1.20.2 11131
1.20.3 11132
1.21 11141
1.22 11150
1.23 11151
1.25 10912
1.29 11164
1.31 10113
1.32 11458
1.81 11118
2.1 10211
2.2 10212
2.3.1 10215
2.3.2 10216
2.3.3 10217
2.3.4 10218
2.3.5 10219
2.3.6 10220
2.3.7 10221
2.4 10213
2.5 10214
3.1 10325
3.2 11167
3.3 10326
3.4 10327
3.5 11168
3.9 11172
3.11 10311
3.12 10312
3.13 10313
3.13-3.14 10313
3.14 10314
3.15 10315
3.17 10514
3.17.1 10316
3.18.1 10317
3.18.2 10318
3.19 10319
3.20.1 11174
3.24 10320
3.25 10328
3.27 10321
3.28 10322
3.29 10323
3.30 10324
3.31 11179
4.1.1 10412
4.1.2 10413
4.1.3 10414
4.1.4 10415
4.1.5 10416
4.1.6 10417
4.2.1 10418
4.2.2 10419
4.3 10411
5.1 10511
5.2 10512
5.5 10521
5.6 10522
5.7.1 10523
5.7.2 11182
5.8 10524
5.8.1 11188
5.9 10525
5.9.1 10516
5.10 10526
5.14 10516
5.14.2 11200
5.16 10513
5.16.2 11202
5.19.3 11203
5.22.1 11204
5.22.2 11205
5.23.1 11206
5.23.2 11207
5.23.3 11208
5.25.3 11209
5.38 11548
5.39 11549
6.2 10613
6.3.1 10614
6.4 10611
6.8.1 10615
6.8.2 10616
6.10 10621
6.12 10620
6.12.2 11210
6.13 10612
6.14.1 10630
6.14.2 10631
6.15.1 10617
6.15.2 10618
6.15.3 10619
6.17 10640
7.1 10711
7.1.2 11211
7.2 10712
7.3 10713
7.4 10714
7.5 10715
7.6 10716
7.7 10717
7.7.1 11219
7.8 10718
7.9 10719
7.9.1 11214
7.10 10720
7.11 10721
7.13 10723
7.13.1 11215
7.14 10724
7.14.1 11355
7.14.2 11450
7.15 10725
7.16 10726
7.17 1447
7.18 10727
7.19 11393
8.1.1 108521
8.1.3 10822
8.1.4 10823
8.2.1 10824
8.2.2 10831
8.2.3 10832
8.2.4 10833
8.2.5 10834
8.2.6 10835
8.3.1 10836
8.3.2 10837
8.3.3 10838
8.4.1 10841
8.4.2 10842
8.4.3 10843
8.4.4 10844
8.5.1 10851
8.5.2 10852
8.5.7 10853
8.8 10811
8.10 10812
8.11 10814
8.12 10815
8.15 10816
10.03 10729
0000010420 10420
1000000005 1000000005
empty 10111
"""

# Name of each sign type, one a line.
_NAMES = """
1.1 Железнодорожный переезд (с шлагбаумом)
1.2 Железнодорожный переезд (без шлагбаума)
1.5 Пересечение с трамвайной линией
1.6 Пересечение равнозначных дорог
1.7 Пересечение с круговым движением
1.8 Светофорное регулирование
1.9 Разводной мост / паромная переправа
1.10 Выезд на набережную
1.11.1 Опасный поворот направо
1.11.2 Опасный поворот налево
1.12.1 Опасные повороты (первый направо)
1.12.2 Опасные повороты (первый налево)
1.13 Крутой спуск
1.14 Крутой подъём
1.15 Скользкая дорога
1.16 Неровная дорога
1.17 Искусственная неровность
1.19 Опасная обочина
1.20.1 Сужение дороги с двух сторон
1.20.2 Сужение дороги справа
1.20.3 Сужение дороги слева
1.21 Дети
1.22 Пешеходный переход
1.23 Дикие животные
1.24 Перегон скота
1.25 Дорожные работы
1.29 Двустороннее движение
1.30 Прочие опасности
1.32 Аварийно-опасный участок
1.60 Въезд запрещен
2.1 Главная дорога
2.2 Конец главной дороги
2.4 Уступите дорогу
2.5 Движение без остановки запрещено
3.1 Движение велосипедов запрещено
3.2 Движение мотоциклов запрещено
3.3 Конец зоны всех ограничений
3.4 Движение гужевых транспортных средств запрещено
3.5 Движение с прицепом запрещено
3.6 Движение транспортных средств запрещено
3.7 Движение тр-ных ср с опасн груз
3.8 Движение запрещено
3.9 Движение груз. авто. запрещ.
3.11 Ограничение минимальной дистанции
3.12 Ограничение ширины
3.13 Ограничение длины
3.14 Остановка запрещена
3.15 Ограничение максимальной скорости
3.18.1 Подача звукового сигнала запрещена
3.18.2 Поворот направо запрещен
3.20.1 Ограничение высоты
3.22 Обгон запрещён
3.24 Ограничение массы
3.26 Разворот запрещен
3.27 Таможня
3.28 Стоянка запрещена (нечётные числа)
3.29 Стоянка запрещена (чётные числа)
3.30 Стоянка запрещена
3.31 Конец зоны запрещения обгона
3.32 Движение тракторов запрещено
4.1.1 Движение прямо
4.1.2 Движение направо
4.1.3 Движение налево
4.1.4 Движение прямо или направо
4.1.5 Движение прямо или налево
4.1.6 Движение направо или налево
4.2.1 Объезд препятствия справа
4.2.2 Объезд препятствия слева
4.3 Круговое движение
5.1 Автомагистраль
5.2 Конец автомагистрали
5.5 Дорога с односторонним движением
5.6 Конец дороги с односторонним движением
5.7.1 Выезд на дорогу с односторонним движением
5.7.2 Выезд на дорогу с односторонним движением (право)
5.8 Направление движения по полосам
5.8.1 Направление движения по полосам
5.9.1 Полоса для маршрутных транспортных средств
5.16 Место остановки автобуса
5.16.2 Пешеходный переход
5.19.3 Тупик
5.22.1 Начало населённого пункта (белый)
5.22.2 Начало населённого пункта (белый с домом)
5.23.1 Конец населённого пункта (белый)
5.23.2 Конец населённого пункта (белый с домом)
5.23.3 Начало населённого пункта (синий)
5.25.3 Конец населённого пункта (синий)
5.38 Жилая зона
5.39 Конец жилой зоны
6.2 Рекомендуемая скорость
6.3.1 Место для разворота
6.4 Место стоянки
6.8.1 Тупик
6.8.2 Тупик впереди
6.10 Указатель направления
6.12 Указатель расстояний
6.13 Километровый знак
6.14.1 Номер маршрута
6.14.2 Номер маршрута (магистраль)
6.15.1 Направление движения грузовых (прямо)
6.15.2 Направление движения грузовых (направо)
6.15.3 Направление движения грузовых (налево)
6.17 Схема объезда
7.1 Пункт питания
7.2 Гостиница или мотель
7.3 Техническое обслуживание
7.4 Туалет
7.5 Питьевая вода
7.7 Такси
7.9 Милиция / ДАИ
7.11 Телефон
7.13.1 Направление главной дороги
7.14.1 Рабочие дни
7.14.2 Транзит
7.15 Зона радиосвязи с аварийными службами
7.16 Кемпинг
7.17 Пост дорожно-патрульной службы
7.18 Автозаправочная станция
7.19 Зона приёма информации о дорожном движении
8.1.1 Расстояние до объекта
8.1.3 Расстояние до объекта (слева)
8.1.4 Расстояние до объекта (справа)
8.2.1 Зона действия
8.2.2 Зона действия (конец)
8.2.3 Зона действия (налево)
8.2.4 Зона действия (протяжённость)
8.2.5 Зона действия (нахождение)
8.2.6 Зона действия (направо)
8.3.1 Направление действия (направо)
8.3.2 Направление действия (справа)
8.3.3 Направление действия (слева)
8.5.7 Выходные дни
8.8 Полоса движения
8.10 Направления действия (обе стороны)
8.12 Платные услуги
8.15 Стоп-линия
"""

# Class lists.
TYPES_WITH_TEXT = ("3.11", "3.12", "3.13", "3.14", "3.15", "3.24", "3.31", "5.22.1", "5.22.2", "5.23.1", "5.23.2", "5.23.3", "5.25.3", "7.1.2", "7.7.1", "7.9.1", "8.1.1", "8.1.3", "8.1.4", "8.2.1", "8.2.2", "8.2.5", "8.2.6")
CITY_TYPES = ("5.22.1", "5.22.2", "5.23.1", "5.23.2", "5.23.3", "5.25.3")
CITY_CLASSES = ("nachalo nas punkta bel", "nachalo nas punkta bel s dom", "nachalo nas punkta sin", "konec nas punkta bel", "konec nas punkta bel s dom", "konec nas punkta sin")
DROPPED_CLASS = "5.16.2"
RENAMED_CLASSES = {"7.13": "7.13.1", "5.7.1-5.7.2": "5.7.1"}
LANE_CLASS = "5.8"
TURN_ANCHORS = {"0": "start", "1": "start", "2": "start", "3": "rev_end", "4": "rev_end", "5": "rev_start", "5.1": "rev_start", "6": "rev_start", "7": "rev_end", "8": "rev_end"}
LANE_DIRECTIONS = {"left": "4.1.3", "right": "4.1.2", "back": "6.3.1"}


def _table(text: str) -> list[tuple[str, str]]:
    return [tuple(line.split(" ", 1)) for line in text.strip().splitlines()]


def sign_codes(spark: SparkSession) -> DataFrame:
    """type, code: the types that features may have. A few types share a code."""
    return spark.createDataFrame(_table(_CODES), "type string, code string")


def sign_names(spark: SparkSession) -> DataFrame:
    """type, name."""
    return spark.createDataFrame(_table(_NAMES), "type string, name string")
